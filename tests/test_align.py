"""Alignment and windows against hand-computed values and a cell-by-cell table."""

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from trailmark.operators.align import ScorerConfig, align, pair_order, score_response
from trailmark.operators.embed import Cached, ConceptEncoder, NgramEncoder, pooled
from trailmark.operators.windows import check_window, covered, kept, spans, windows_of


@pytest.mark.parametrize(
    ("rows", "path", "match", "order"),
    [
        # in order, with a window between
        ([[0.8, 0.0, 0.3, 0.1], [0.2, 0.4, 0.7, 0.66]], [(0, 0), (1, 2)], 1, 1),
        # nothing reaches the threshold
        ([[0.5, 0.64, 0.1]], [], 0, 0),
        # both best at one window: only the better step has it, and the pair counts half
        ([[0.7, 0.1], [0.9, 0.2]], [(1, 0)], 0.5, 0.5),
        # the two steps swapped: the larger one is matched
        ([[0.1, 0.75], [0.7, 0.2]], [(0, 1)], 0.5, 0),
        # four steps, the second out of order: 5 of 6 pairs in order
        ([[0.0, 0.9, 0.0, 0.0], [0.8, 0.0, 0.0, 0.0], [0.0, 0.0, 0.9, 0.0], [0.0, 0.0, 0.0, 0.7]], [(0, 1), (2, 2), (3, 3)], 0.75, 5 / 6),
    ],
)
def test_fixtures(rows, path, match, order):
    a = align(np.array(rows, dtype=np.float32), 0.65)
    assert (a.path, a.match_rate) == (path, match)
    assert a.order_rate == pytest.approx(order)


def cell_by_cell(sim, threshold):
    n, m = sim.shape
    d = np.zeros((n + 1, m + 1), dtype=np.float32)
    move = np.zeros((n + 1, m + 1), dtype=int)
    for i in range(n):
        for j in range(m):
            g = sim[i, j] if sim[i, j] >= threshold else np.float32(0)
            options = {2: d[i + 1, j], 3: d[i, j + 1]}
            if g > 0:
                options[1] = d[i, j] + g
            best = max(options.values())
            move[i + 1, j + 1] = next(k for k in (1, 2, 3) if k in options and options[k] == best)
            d[i + 1, j + 1] = best
    i, j, path = n, m, []
    while i and j:
        k = move[i, j]
        if k == 1:
            path.append((i - 1, j - 1))
        i, j = i - (k != 2), j - (k != 3)
    return path[::-1], d[-1, -1]


def test_table_matches_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(300):
        sim = rng.random((rng.integers(1, 7), rng.integers(1, 12))).astype(np.float32)
        if rng.random() < 0.6:
            sim = np.round(sim * 4) / np.float32(4)
        path, score = cell_by_cell(sim, np.float32(0.5))
        a = align(sim, 0.5)
        assert a.path == path and a.score == pytest.approx(score)


def test_pair_order():
    assert pair_order([]) == 0 and pair_order([3]) == 1 and pair_order([1, 1]) == 0.5 and pair_order([2, 1]) == 0


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab 。,\n", max_size=300), st.integers(2, 20))
def test_windows_cover_and_advance(text, window):
    stride = window // 2
    found, stats = windows_of(text, window, stride, 1000)
    text = text.strip()
    if not text:
        assert found == [] and stats[0] == 0
        return
    assert found[0][1] == 0 and found[-1][2] == len(text)
    starts = [s for _, s, _, _ in found]
    assert starts == sorted(set(starts))
    assert stats[4] == len({c for _, s, e, _ in found for c in range(s, e)})


def test_caps_keep_head_and_tail():
    text = "token " * 4096
    found, stats = windows_of(text, 48, 24, 256)
    assert len(found) == 256 and found[0][1] == 0 and found[-1][2] == len(text.strip()) and stats[3] and stats[6]
    assert kept(10, 1) == [9] and kept(3, 5) == [0, 1, 2]
    assert spans("abcdefghij", 4, 2)[:2] == [(0, 4), (2, 6)]
    assert covered([(0, 4), (6, 8)]) == 6
    for bad in ((0, 1, 1), (4, 4, 1), (4, 2, 0)):
        with pytest.raises(ValueError):
            check_window(*bad)


def test_linear_score_and_candidates():
    encode = Cached(ConceptEncoder({"read": ["read"], "edit": ["edit"], "test": ["test"]})).encode
    config = ScorerConfig(fine=(16, 8))
    text = "I read the file. Then I edit the code. Then I test it all."
    got = score_response(encode, text, [["read task"], ["edit code"], ["test code"]], config)
    assert got["match_rate"] == 1 and got["matched_steps"] == ["read task", "edit code", "test code"]
    none = score_response(encode, text, [["read task"], ["sing a song", "dance"]], config)
    assert none["match_rate"] == 0.5 and none["unmatched_steps"] == ["sing a song | dance"]
    assert score_response(encode, "", [["read"]], config)["score"] == 0 and score_response(encode, text, [], config)["score"] == 0


def test_cache_and_pooling():
    c = Cached(NgramEncoder(), size=2)
    c.encode(["a b", "c"])
    c.encode(["a b"])
    assert (c.hits, c.misses) == (1, 2)
    v = pooled(np.array([[[3.0, 4.0], [0.0, 0.0]]]), np.array([[1, 0]]))
    assert np.allclose(v, [[0.6, 0.8]])
