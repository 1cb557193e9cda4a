"""Training-data operators against brute force, round trips and small fixtures with nulls, ties, repeats and empty tables."""

import datetime as dt
import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trailmark.llm import lookalike, mixing, packing, pairs, pieces, queries, repetition, runs, subjects, tokens

NOW = dt.datetime(2025, 1, 1)


# ----------------------------------------------------------------- 1 pieces


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abé。，； \n.x", min_size=1, max_size=400), st.integers(5, 60), st.integers(0, 70))
def test_pieces_round_trip(text, limit, overlap):
    parts, stretch = pieces.split_text(text, limit, overlap)
    assert stretch == max(map(len, re.split("[ \n。，；]", text)))
    if len(text) <= limit:
        assert parts == [(0, len(text), "end")]
        return
    overlap = min(overlap, limit - 1)
    assert parts[0][0] == 0 and parts[-1][1] == len(text)
    for (s, e, cut), (s2, e2, _) in zip(parts, parts[1:], strict=False):
        assert e - s <= limit and e2 - s2 <= limit and e2 > e
        assert s2 == max(0, e - overlap)
        assert cut == "forced" or text[e - 1] in pieces.NATURAL
    if stretch <= limit - overlap - 1 and "forced" in {c for *_, c in parts}:
        raise AssertionError("a forced cut where natural places would do")


def test_plan_is_the_cheapest():
    rng = random.Random(3)
    for _ in range(60):
        text = "".join(rng.choice("ab .,\n") for _ in range(rng.randint(30, 70)))
        limit, overlap = rng.randint(18, 25), rng.randint(0, 6)
        code = np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)
        n, step = len(text), limit - overlap
        at, kind = pieces.candidates(code, pieces.natural_positions(code), step)
        ends, kinds = pieces.plan_cuts(n, at, kind, limit, overlap)
        cost = lambda cut, mean: sum(pieces.PENALTY[k] for _, k in cut) + sum(pieces.BALANCE * ((b - a) / mean - 1) ** 2 for (a, _), (b, _) in zip([(0, 0), *cut], [*cut, (n, 6)], strict=True))
        options = [*zip(at.tolist(), kind.tolist(), strict=True)]
        mean = n / len(ends)

        def search(last, cut, first, left):
            room = limit if first else step
            if left == 1:
                return [cut] if n - last <= room else []
            return [x for p in options if last < p[0] <= last + room for x in search(p[0], [*cut, p], False, left - 1)]

        every = search(0, [], True, len(ends))
        assert not any(search(0, [], True, k) for k in range(1, len(ends)))
        mine = [*zip(ends[:-1], kinds[:-1], strict=True)]
        assert cost(mine, mean) == pytest.approx(min(cost(c, mean) for c in every), abs=1e-3)


def test_split_oversized_rows(spark):
    limits = spark.createDataFrame([("default", 10, 2), ("k", 4, None), ("z", None, 1)], "subtype string, max_chars int, overlap_chars int")
    rows = [("a", "one two three four", None, 1), ("b", None, "k", 1), ("c", "", "k", 1), ("d", "abcdefgh", "k", 1), ("e", "x y", "none", 1), (None, "aaaa bbbb cccc", "z", 1)]
    df = spark.createDataFrame(rows, "id string, response string, subtype string, piece int")
    got = pieces.split_oversized(df, limits).orderBy("id", "piece_index").collect()
    assert {r.id for r in got} == {"a", "d", None}
    assert [r.piece for r in got if r.id == "d"] == ["abcd", "efgh"] and {r.cut for r in got if r.id == "d"} == {"forced", "end"}
    assert pieces.split_oversized(df.limit(0), limits).count() == 0 and pieces.split_oversized(df, limits.limit(0)).count() == 0


# ------------------------------------------------------------- 2 look-alikes


@pytest.mark.parametrize("a,b", [("ｆｕｌｌ－１", "full-1"), ("café", "café"), ("a​b­c", "abc"), ("a b　c", "a b c"), ("еѕ", "es"), ("ﬁn", "fin"),
                                 ("µs", "μs"), ("K", "K"), ("（x）", "(x)"), ("й", "й"), ("\U0001d41a", "a")])
def test_reads_the_same(a, b):
    assert lookalike.skeleton(a) == lookalike.skeleton(b)


@pytest.mark.parametrize("a,b", [("x2", "x²"), ("a", "A"), ("e", "é"), ("1", "2"), ("a b", "ab"), ("a b", "a  b"), ("l", "1"), ("O", "0")])
def test_reads_differently(a, b):
    assert lookalike.skeleton(a) != lookalike.skeleton(b)


@pytest.mark.parametrize("a,b", [("app\u04cfe", "apple"), ("f\u03c3rm", "form"), ("\u2c9f\u2ca3en", "open"), ("\ua4e0\ua4f3\ua4f2", "NOI"), ("\u1d22ip", "zip"), ("\u0433un", "run"),
                                 ("\u0585\u057c", "on"), ("\u05e1k", "ok"), ("\U0001d6d4k", "ok"), ("\u15afus", "bus")])
def test_letters_of_more_scripts_read_the_same(spark, a, b):
    table = lookalike.Table(lookalike.confusables(spark))
    assert lookalike.skeleton(a, table) == lookalike.skeleton(b, table) == b


def test_public_letters_tell_case_and_digits_apart(spark):
    more = lookalike.confusables(spark)
    table = lookalike.Table(more)
    assert len(more) > 500 and all(p.isascii() and p.isalpha() and lookalike.skeleton(chr(c), table) in (p, *lookalike.PROTOTYPES) for c, p in more.items())
    for a, b in (("\u0399", "l"), ("\u04c0", "l"), ("\ua4f2", "l"), ("\u2c92", "i"), ("1", "I"), ("0", "O"), ("m", "rn"), ("é", "e")):
        assert lookalike.skeleton(a, table) != lookalike.skeleton(b, table)
    for a, b in (("ꓐ", "B"), ("ꓳ", "O"), ("ꓲ", "I"), ("Ⲟ", "O"), ("Ꭵ", "i"), ("Ꮷ", "d"), ("σ", "o"), ("յ", "j"), ("ᴏ", "o")):
        assert lookalike.skeleton(a, table) == b


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_skeleton_is_stable(spark, t):
    for table in (lookalike.Table({}), lookalike.Table(lookalike.confusables(spark))):
        assert lookalike.skeleton(lookalike.skeleton(t, table), table) == lookalike.skeleton(t, table)


def test_pairs_equal_brute_force(spark):
    rng = random.Random(7)
    words = ["abc", "аbc", "abc​", "ＡBC", "ABC", "x y", "x y", "...", "．．．", "", None]
    rows = [(rng.choice("rs"), f"i{k}", rng.choice(["p", "q", None]), NOW, rng.choice(words)) for k in range(60)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "field string, id string, scope string, delivered timestamp, text string")
    classes = lookalike.lookalike_classes(df)
    got = {tuple(r) for r in lookalike.lookalike_pairs(classes).collect()}
    split = lookalike.lookalike_pairs(classes, rows=2).collect()
    assert len(split) == len(got) and {tuple(r) for r in split} == got
    uniq = {(f, i, s, t) for f, i, s, _, t in rows if t is not None}
    want = {
        (a[0], *sorted((a[1], b[1]))) for a in uniq for b in uniq
        if a[0] == b[0] and a[2] == b[2] and a[1] < b[1] and a[3] != b[3] and lookalike.skeleton(a[3]) == lookalike.skeleton(b[3])
    }
    assert got == want and len(want) > 10
    assert lookalike.lookalike_classes(df.limit(0)).count() == 0
    norm = {r.id: r.skeleton for r in lookalike.normalize_text(df, "id", "text").collect()}
    assert norm["i0"] == (None if rows[0][4] is None else lookalike.skeleton(rows[0][4]))


# ------------------------------------------------------------- 3 broken pairs

STEPS = "open the start page (walnut)\x02search the catalogue\x01search it\x02filter the hits"


@pytest.mark.parametrize("response,want", [
    (None, "empty"), ("", "empty"), (" ​ ", "empty"), ("```\n```", "empty"), ("<think></think>", "empty"), ("N/A", "empty"), ("—", "empty"), ("无", "empty"),
    ("1. Open the start page (walnut)\n2. search it\n3. filter the hits", "copied"), ("Sure: [\"open the start page\", \"filter the hits\"]", "copied"),
    ("OPEN THE START PAGE -> SEARCH THE CATALOGUE", "copied"),
    ("I'm sorry, but I can't help with that task.", "refusal"), ("You asked me to filter the hits. This assistant does not handle such requests.", "refusal"), ("很遗憾，我无法协助此类任务。", "refusal"),
    ("The page was opened and the form in it was filled. After that the hits will need to", "truncated"), ("All of it is done.\n```python\ndef f(", "truncated"),
    ("Done it with the tool.\n<run_test>pytest tests/x", "truncated"), ("Done it with the tool.\n{\"tool\": \"x\", \"args\": {\"a\":", "truncated"),
    ("Die Prüfung ist nun ohne Fehler und die Seite wurde mit der Suche gefunden.", "language"), ("之后测试全部通过，另外补充了校验。", "language"),
    ("The start page is open and the hits are filtered by the new form.", None), ("Sorry for the noise in app.py, the log printed too much. The page is open now.", None),
    ("We opened it.\ntests/a.py::test_b PASSED [10%]", None), ("We opened it.\n- src/a.py", None), ("It is done.\n```python\nx = f(1)\n```", None),
])
def test_defects(response, want):
    assert pairs.defect(response, STEPS) == want


def test_refusals_of_any_length():
    long = "I'm sorry, but I can't help with that task, because " + "it asks for more than the rules of this place allow and " * 14 + "that is all."
    assert len(long) > 600 and pairs.defect(long, STEPS) == "refusal" and pairs.defect(long + " " * 700, STEPS) == "refusal"
    worked = long + " The start page was opened." * 4
    assert pairs.defect(worked, STEPS) is None


def test_automaton_equals_substring_search():
    rng = random.Random(11)
    for _ in range(200):
        texts = [[rng.choice("abc") for _ in range(rng.randint(1, 6))] for _ in range(3)]
        seq = [w for t in texts for w in [*t, None]]
        a = pairs.SuffixAutomaton(seq)
        said = [rng.choice("abcd") for _ in range(12)]
        got = a.covered(said)
        grams = {tuple(t[i : i + 2]) for t in texts for i in range(len(t) - 1)}
        want = [False] * 12
        for i in range(11):
            if tuple(said[i : i + 2]) in grams:
                want[i] = want[i + 1] = True
        assert got == want


#: Phrasings of which no list has the whole.
HELD_OUT = [
    "I regret that I am prohibited from performing this.", "That falls outside the scope of my abilities, so I must leave it.", "Sadly, this is something I'm not comfortable assisting with.",
    "I'm going to have to say no to this request.", "We are not in a position to fulfil your request.", "My guidelines prevent me from doing this.", "This assistant is barred from performing that.",
    "Apologies, but my instructions do not let me do that.", "I'm unwilling to take this on.", "Our policy forbids us to assist here.", "I will have to turn this down, as what you ask for goes against my guidelines.",
    "Diese Anfrage kann ich leider nicht ausführen.", "Es ist mir untersagt, dabei zu helfen.", "Ich werde diese Aufgabe nicht übernehmen.", "Das liegt außerhalb meiner Möglichkeiten.", "Ihrem Wunsch können wir nicht nachkommen.",
    "Je ne suis pas en mesure de répondre à cette demande.", "Il m'est interdit de faire cela.", "Je préfère décliner cette tâche.", "Nous refusons de traiter ce genre de requête.",
    "No estoy autorizado para atender esta solicitud.", "Me niego a colaborar con eso.", "Esto queda fuera de mi alcance.", "Debo abstenerme de cumplir esta tarea.",
    "这超出了我的能力范围，我没办法处理。", "我不便提供此类帮助。", "本助手不能执行该要求。", "请谅解，我拒绝执行。",
]


def test_refusals_in_other_words():
    found = [pairs.is_refusal(t) for t in HELD_OUT]
    assert sum(found) / len(found) >= 0.9
    assert pairs.is_refusal("I can't help with that task. " + "I must decline that request. " * 20)
    assert pairs.is_refusal("My guidelines prevent me from doing this. " * 30)
    for text in ("I cannot reproduce the failure on my machine, so a log was added.", "The server refused the call and I tried it again.", "We won't see that error any more, the page is open.",
                 "Ich habe das nicht gefunden, die Seite ist aber offen.", "我没有找到错误，页面已经打开。", "I said no to src/a.py because this request is stale; b.py was merged."):
        assert not pairs.is_refusal(text)


def test_copied_coverage():
    assert pairs.copied_coverage("1. Open the start page (walnut)\n2. search it\n3. filter the hits", STEPS) == 1.0
    assert pairs.copied_coverage("open the start page, then nothing new", STEPS) == pytest.approx(4 / 7)
    assert pairs.copied_coverage("", STEPS) == pairs.copied_coverage("other words", STEPS) == pairs.copied_coverage("open", "") == 0.0


@pytest.mark.parametrize("end,want", [
    ("- retry_row The remaining nested ledger comes from th", "truncated"), ("- mailer.shift so that decode_anchor can be ca", "truncated"), ("- clamp_window接下来需要把vault的", "truncated"),
    ("tests/a.py::test_b PASSED [79%]lib/digest_", "truncated"), ("12:    a = fold(b)接下来需要把a的", "truncated"),
    ("- retry_row", None), ("- mailer.shift", None), ("- add a guard", None), ("- README.md updated for it", None), ("tests/a.py::test_b PASSED [79%]", None),
])
def test_ends_of_lists_and_logs(end, want):
    assert pairs.defect("The start page is open now and it works.\n" + end, STEPS) == want


def test_broken_pairs_rows(spark):
    rows = [("a", "N/A", [["x y"]], NOW, "z"), ("a", "The work is done and the page is open.", [["open the page"]], NOW + dt.timedelta(1), "z"), ("b", None, None, NOW, "z"), (None, "", None, NOW, "z"), ("c", "fine words that end.", [], NOW, "z")]
    df = spark.createDataFrame(rows, "id string, response string, reference_steps array<array<string>>, ingested_at timestamp, defect string")
    assert {tuple(r) for r in pairs.broken_pairs(df).collect()} == {("b", "empty")}
    assert pairs.broken_pairs(df.limit(0)).count() == 0
    got = [(r.id, r.copied_coverage, r.n_words, r.defect) for r in pairs.pair_measures(df).collect()]
    assert len(got) == 5 and ("b", 0.0, 0, "empty") in got and pairs.pair_measures(df.limit(0)).count() == 0


# -------------------------------------------------------------------- 4 runs


@pytest.mark.parametrize("tasks,apart", [(1, 1), (2, 1), (7, 10_000), (60, 1)])
def test_runs_equal_brute_force(spark, tasks, apart):
    rng = random.Random(tasks)
    rows, want = [], []
    for t in ["a", "b", "c"]:
        o, seq = 0, []
        for _ in range(60):
            o += rng.choice([1, 1, 1, 3]) * apart
            seq.append((o, rng.choice(["evt-007", "E7.dup", "x 8", "none"]), rng.choice(["run_tests", " Run-Tests", None]), rng.choice([1, 2, None]), NOW + dt.timedelta(seconds=o)))
        for s in seq:
            rows.append((t, s[0], s[1], s[2], s[3], s[4], NOW))
            if rng.random() < 0.1:
                rows.append((t, s[0], "old-99", "old", 9, s[4], NOW - dt.timedelta(1)))
        number = lambda e: (m := re.search(r"\d+", e)) and str(int(m[0]))
        node = lambda n: None if n is None else re.sub(r"[\s_-]+", "_", n.strip()).lower()
        run = [seq[0]]
        for p, q in zip(seq, seq[1:], strict=False):
            if number(p[1]) and number(p[1]) == number(q[1]) and node(p[2]) == node(q[2]) and (p[3] is None or q[3] is None or p[3] == q[3]):
                run.append(q)
            else:
                want.append((t, run[0][0], run[-1][0], len(run), float(run[-1][0] - run[0][0])))
                run = [q]
        want.append((t, run[0][0], run[-1][0], len(run), float(run[-1][0] - run[0][0])))
    rows += [(None, 1, "e1", None, None, NOW, NOW), ("d", None, "e1", None, None, NOW, NOW)]
    df = spark.createDataFrame(rows, "traj_id string, ord int, event_id string, node_id string, occurrence int, ts timestamp, ingested_at timestamp").withColumn("run", F.lit(1))
    got = runs.collapse_runs(df, tasks=tasks).select("traj_id", "first_ord", "last_ord", "n_events", "duration_seconds").collect()
    assert sorted(tuple(r) for r in got) == sorted(want)
    assert runs.collapse_runs(df.limit(0)).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 50])
def test_runs_across_batches(size):
    rng = random.Random(size)
    rows = sorted({(rng.choice("ab"), o): None for o in range(40)})
    rows = [(t, o, rng.choice(["1", "1", "1", None]), rng.choice(["x", None]), rng.choice([1, 2, None]), rng.choice([o * 10, None])) for t, o in rows for _ in range(rng.choice([1, 1, 2]))]
    batch = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)],
                                       names=["traj_id", "ord", "number", "node", "occ", "ts"])
    whole = [r for b in runs.encoded(iter([batch]), 3) for r in b.to_pylist()]
    parts = [r for b in runs.encoded((batch.slice(i, size) for i in range(0, len(rows), size)), 3) for r in b.to_pylist()]
    assert parts == whole and [r["edge"] for r in whole] == [True, *[False] * (len(whole) - 2), True]
    assert sum(r["n_events"] for r in whole) == len({r[:2] for r in rows})


# -------------------------------------------------------------- 5 repetition


def repeated(text):
    w = [x for x in re.findall(r"[一-鿿]|[^\W_一-鿿]+", text.lower())]
    seen, mark = set(), [False] * len(w)
    for i in range(len(w) - 4):
        g = tuple(w[i : i + 5])
        if g in seen:
            mark[i : i + 5] = [True] * 5
        seen.add(g)
    return len(w), sum(mark)


def test_repetition_equals_brute_force(spark):
    rng = random.Random(2)
    texts = [None, "", "a b c d", "A b c d e a B c d E", "好" * 30, "x " * 500]
    texts += [" ".join(rng.choice(["a", "b", "Cé", "9", "好"]) for _ in range(rng.randint(0, 60))) for _ in range(80)]
    df = spark.createDataFrame([(str(i), t, 1) for i, t in enumerate(texts)], "id string, response string, n_words int")
    for r in repetition.repetition_report(df.select("id", "response"), "id", "response").collect():
        assert (r.n_words, r.repeated_words) == repeated(texts[int(r.id)] or "")
    report = {r.id: r for r in repetition.repetition_report(df.select("id", "response"), "id", "response").collect()}
    assert report["5"].fired[0] == "repeated_word_share>=0.4" and report["0"].repeated_word_share == 0


# ----------------------------------------------------------------- 6 packing


@pytest.mark.parametrize("capacity", [4096, 1000, 64])
def test_plan_uses_every_text_once(capacity):
    rng = np.random.default_rng(capacity)
    hist = np.zeros(capacity + 1, dtype=np.int64)
    for s in rng.integers(1, capacity + 1, 300) // rng.integers(1, 9, 300) + 1:
        hist[min(s, capacity)] += rng.integers(1, 12)
    slots, room, containers = packing.plan_containers(hist, capacity)
    held, ranks, fitted = np.zeros(containers, dtype=np.int64), {}, 0
    for s in slots:
        for rank in range(s.lo, s.hi):
            assert (s.size, rank) not in ranks
            ranks[s.size, rank] = True
            held[(s.start + (s.skip + rank - s.lo) // s.n * s.width) // room] += s.size
        fitted += s.fitted * (s.hi - s.lo) * s.size
    assert len(ranks) == hist.sum() and all(rank < hist[size] for size, rank in ranks)
    assert held.max() <= capacity and held.min() > 0
    total = int((hist * np.arange(capacity + 1)).sum())
    # first fit, largest first
    rooms: list[int] = []
    for s in range(capacity, 0, -1):
        for _ in range(hist[s]):
            k = next((k for k, r in enumerate(rooms) if r >= s), None)
            if k is None:
                rooms.append(capacity - s)
            else:
                rooms[k] -= s
    assert containers <= 1.01 * len(rooms) + 1 and (fitted / total > 0.8 or capacity == 64)


def test_repeats_explain_a_histogram_of_patterns():
    patterns = packing.enumerate_patterns(12)
    assert all(sum(p) == 12 for p in patterns.tolist()) and len({tuple(p) for p in patterns.tolist()}) == len(patterns) == 19
    hist = np.zeros(13)
    for p, n in (((7, 5, 0), 30), ((10, 1, 1), 20), ((12, 0, 0), 4)):
        for s in p:
            hist[s] += n * (s > 0)
    x = packing.fit_repeats(hist, patterns, steps=3000)
    used = sum(np.bincount(patterns[:, k], weights=x, minlength=13) for k in range(3))
    assert np.allclose(used[7:], hist[7:], atol=0.2) and (used[1:7] <= hist[1:7] + 0.2).all()
    assert packing.rounded(np.array([0.4, 0.4, 0.4, 1.0, 0.3])).tolist() == [0, 1, 0, 1, 1]
    assert packing.plan_containers(np.zeros(257, dtype=np.int64), 256)[::2] == ([], 0)


def test_pack_rows(spark):
    rng = random.Random(6)
    sizes = [rng.choice([10, 50, 300, 900, 4096, 4097, 9000]) for _ in range(300)]
    df = spark.createDataFrame([(i, s) for i, s in enumerate(sizes)], "doc_id long, tokens long")
    got = packing.pack_sized(df, 4096).collect()
    held = {}
    for r in got:
        held.setdefault(r.container_id, []).append(r)
    for rows in held.values():
        total = sum(r.tokens for r in rows)
        assert total <= 4096 and all(r.fill == pytest.approx(total / 4096) for r in rows)
    per = {}
    for r in got:
        per.setdefault(r.doc_id, []).append((r.part, r.tokens))
    assert {d: sum(t for _, t in p) for d, p in per.items()} == dict(enumerate(sizes))
    assert all(len(per[i]) == -(-s // 4096) for i, s in enumerate(sizes))
    empty = spark.createDataFrame([(1, None, "x"), (2, "", "x")], "doc_id long, text string, size string")
    assert packing.pack(empty, 4096).count() == 0
    with pytest.raises(ValueError):
        packing.pack(empty, 10)


def test_tokens(spark):
    df = spark.createDataFrame([(1, "hello world"), (2, None), (3, "")], "doc_id long, text string")
    got = {r.doc_id: r.tokens for r in tokens.with_tokens(df, "text", ["doc_id"]).collect()}
    assert got == {1: 2, 2: 0, 3: 0}


# ------------------------------------------------------------------ 7 mixing


def test_mix(spark):
    rng = random.Random(8)
    docs = [(i, rng.choice(["a", "a", "a", "b", None]), rng.randint(1, 50)) for i in range(2000)] + [(9999, "c", 0)]
    sized = spark.createDataFrame(docs, "doc_id long, source string, tokens long")
    total = sum(t for _, _, t in docs)
    size = {s: sum(t for _, x, t in docs if x == s) for s in "ab"}
    rows = [("m", 0.5, "a", 0.3, 1), ("m", 0.5, "b", 0.9, 2), ("m", 0.5, "zz", 0.1, 3), ("n", 2.0, "b", 0.2, 5), ("n", None, "a", 0.5, None), (None, 1.0, "a", 0.5, 1)]
    targets = spark.createDataFrame(rows, "mix_id string, total_ratio double, source string, target_share double, max_repeats int")
    plan = {(r.mix_id, r.source): r for r in mixing.mix_plan(sized, targets).collect()}
    assert plan["m", "a"].reachable and not plan["m", "zz"].reachable
    assert plan["m", "b"].reachable == (2 * size["b"] >= 0.9 * 0.5 * total)
    drawn = mixing.draw_mix(sized, mixing.mix_plan(sized, targets)).collect()
    assert len({(r.mix_id, r.doc_id) for r in drawn}) == len(drawn)
    for key, p in plan.items():
        got = sum(r.repeats * r.tokens for r in drawn if (r.mix_id, r.source) == key)
        assert abs(got - p.budget) <= 50 and all(r.repeats <= p.max_repeats for r in drawn if (r.mix_id, r.source) == key)
    assert mixing.draw_mix(sized.limit(0), mixing.mix_plan(sized.limit(0), targets)).count() == 0


def test_tempered_budgets_reach_the_total():
    sizes, total = {"a": 800, "b": 150, "c": 50}, 1000
    # b and c cannot give what is asked, a tempered mix of the same size can
    rows = [("a", 0.5, 0.2, 1), ("b", 0.5, 0.5, 1), ("c", 0.5, 0.3, 1)]
    plan = mixing.plan_mix(rows, sizes, total)
    assert [p["reachable"] for p in plan] == [True, False, False] and 0 < plan[0]["limit_exponent"] < 1
    assert sum(p["budget"] for p in plan) == pytest.approx(500) and all(p["budget"] <= p["limit_tokens"] + 1e-6 for p in plan)
    w = mixing.tempered([0.2, 0.5, 0.3], [0.8, 0.15, 0.05], plan[0]["limit_exponent"])
    assert [p["planned_share"] for p in plan] == pytest.approx(w)
    # targets that hold are drawn as they are
    fine = mixing.plan_mix([("a", 0.1, 0.5, 1), ("b", 0.1, 0.5, 1)], sizes, total)
    assert [p["budget"] for p in fine] == pytest.approx([50, 50]) and fine[0]["limit_exponent"] == 0
    # no exponent is enough: the others take over, and only if all are at their limits the mix is short
    over = mixing.plan_mix([("a", 0.9, 0.1, 1), ("b", 0.9, 0.9, 1)], sizes, total)
    assert [p["budget"] for p in over] == pytest.approx([750, 150])
    assert sum(p["budget"] for p in mixing.plan_mix([("b", 0.9, 0.9, 1), ("c", 0.9, 0.1, 1)], sizes, total)) == pytest.approx(200)
    assert mixing.within_limits([0.0, 0.5, 0.5], 10.0, [9.0, 2.0, 20.0]) == pytest.approx([0.0, 2.0, 8.0])


def test_temperatures():
    w = mixing.tempered([0.5, 0.5], [0.9, 0.1], 1.0)
    assert w == pytest.approx([0.9, 0.1]) and mixing.tempered([0.5, 0.5], [0.9, 0.1], 0.0) == [0.5, 0.5]
    e = mixing.bisect_exponent(lambda e: mixing.tempered([0.5, 0.5], [0.9, 0.1], e)[1] <= 0.2)
    assert mixing.tempered([0.5, 0.5], [0.9, 0.1], e)[1] == pytest.approx(0.2)
    a = mixing.temperature_for_entropy([0.7, 0.2, 0.1], 1.0)
    raw = [s**a for s in (0.7, 0.2, 0.1)]
    assert mixing.entropy([r / sum(raw) for r in raw]) == pytest.approx(1.0)


# ---------------------------------------------------------------- 8 subjects


def test_transaction_parts():
    text = "commit abcdef1234567\r\nAuthor: bond <x@y>\r\n\r\n    fix orbit\r\ndiff --git a/src/starMap.py b/src/starMap.py\nindex 1..2\n--- a/x\n+++ b/x\n@@ -1 +1 @@ def fold_comet\n-old_galaxy\n+newNebula\n"
    message, code = subjects.transaction(text)
    assert message == {"fix", "orbit"} and code == {"src", "star", "map", "def", "fold", "comet", "old", "galaxy", "new", "nebula"}


def rated_table(spark, rows):
    return spark.createDataFrame(rows, "message string, code string, subjects array<string>")


@pytest.mark.parametrize("slices", [1, 4])
def test_mined_rules_equal_brute_force(spark, slices, monkeypatch):
    rng = random.Random(2)
    docs = []
    for i in range(90):
        s = ("alpha", "beta", "gamma")[i % 3]
        words = {f"{s}{k}" for k in range(3) if rng.random() < 0.8} | {f"shared{k}" for k in range(12) if rng.random() < (0.75 if k % 3 == i % 3 else 0.4)}
        docs.append((words, s))
    rows = [(" ".join(sorted(w)[::2]), " ".join(sorted(w)[1::2]), [s]) for w, s in docs] + [("alpha1 beta2", "", ["alpha", "beta"])]
    monkeypatch.setattr(subjects, "GROUP_ROWS", 90 // slices + 1)
    monkeypatch.setattr(subjects, "GROUP_ITEMS", 3)
    monkeypatch.setattr(subjects, "ITEM_LIFT", 1.05)
    got = subjects.mine_rules(rated_table(spark, rows), subjects.single, lambda s, c, share, n: c >= 0.6, lambda n: 5)
    count = lambda ws, s: sum(t == s and ws <= w for w, t in docs)
    every = sorted({w for words, _ in docs for w in words})
    found, items = {}, set()
    for size in (1, 2, 3):
        for ws in map(frozenset, itertools.combinations(every, size)):
            if size > 1 and not ws <= items:
                continue
            n, s = max((count(ws, s), s) for s in ("alpha", "beta", "gamma"))
            total = sum(ws <= w for w, _ in docs)
            careful = n / total if size == 1 else (n + subjects.PRIOR / 3) / (total + subjects.PRIOR)
            if n >= 5 and careful >= 0.6:
                found[ws] = (s, n / total)
            elif size == 1 and n / total >= 1.05 / 3:
                items |= ws
    want = {a: v for a, v in found.items() if not any(b < a and found[b][1] >= v[1] for b in found)}
    assert got == want and {len(a) for a in got} == {1, 2, 3}


def test_prefix_tree_grows_all_patterns():
    rng = random.Random(4)
    sets = [tuple(sorted(rng.sample(range(7), rng.randint(1, 5)))) for _ in range(40)]
    tree = subjects.PrefixTree()
    for k, s in enumerate(sets):
        tree.insert(s, subjects.Counter({"ab"[k % 2]: 1}))
    got = {p: (c["a"], c["b"]) for p, c in tree.grow(range(7), 3, 2)}
    want = {}
    for size in (1, 2, 3):
        for p in itertools.combinations(range(7), size):
            n = [sum(set(p) <= set(s) and k % 2 == x for k, s in enumerate(sets)) for x in (0, 1)]
            if sum(n) >= 2:
                want[p] = tuple(n)
    assert got == want


def test_rules_of_longer_patterns_count_as_evidence():
    m = subjects.Matcher({frozenset(["a"]): ("x", 0.75), frozenset(["b", "c"]): ("x", 0.9), frozenset(["c", "d"]): ("y", 0.75)})
    got = m.evidence({"a", "b"}, {"c"})
    assert got == {"x": (pytest.approx(1 + 2 * 0.9 / 0.75), 3, 1)} and m.clear({"a", "b"}, {"c"}, None) == "x"
    assert subjects.pruned({frozenset("ab"): ("x", 0.8), frozenset("a"): ("x", 0.8), frozenset("abc"): ("x", 0.9)}) == {frozenset("a"): ("x", 0.8), frozenset("abc"): ("x", 0.9)}


def test_sample_and_its_calibration(spark):
    ratings = spark.range(8_000).select(F.col("id").alias("doc_id"), F.lit("alpha").alias("subject"))
    assert subjects.sample_ratings(ratings).count() == 8_000
    matcher = subjects.Matcher({frozenset([w]): ("alpha", 0.75) for w in "uvwx"})
    rows = [("u", "v w", ["alpha"]), ("u", "v", ["beta"]), ("u v w", "", ["none"])]
    assert [subjects.calibrate(matcher, rated_table(spark, r)) for r in (rows * 100, rows, rows[:1], [])] == [2.5, 1.5, 1.5, 1.5]


def test_subjects_on_held_out_documents(spark):
    rng = random.Random(9)
    vocabulary = {s: [f"{s}word{chr(97 + k)}" for k in range(12)] for s in ("alpha", "beta", "gamma")}
    rows, truth, rated = [(0, None), (1, ""), (None, "diff --git a/x b/x")], set(), []
    for i in range(2, 400):
        own = rng.sample(sorted(vocabulary), rng.choice([0, 1, 1, 1, 2]))
        words = [w for s in own for w in rng.sample(vocabulary[s], 5)]
        other = rng.choice(vocabulary[rng.choice(sorted(vocabulary))])
        lines = "\n".join(f"+{w}_item = common_{rng.choice('xyz')}value" for w in words)
        rows.append((i, f"see {other}\n\ndiff --git a/item.py b/item.py\n{lines}\n context shared"))
        truth |= {(i, s) for s in own}
        if i % 4 == 0:
            rated += [(i, s) for s in own] or [(i, "none")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("subject", F.lit("clash"))
    labels = spark.createDataFrame(rated, "doc_id long, subject string")
    areas = spark.createDataFrame([(s, f"{s} things") for s in vocabulary], "subject string, covers string")
    found = subjects.document_subjects(docs, labels, areas)
    got = {(r.doc_id, r.subject) for r in found.collect()}
    held = {x for x in truth if x[0] % 4}
    assert len(held & got) / len(held) > 0.95 and len(got & truth) / len(got) > 0.95
    shares = {r.subject: r.n_docs for r in subjects.corpus_composition(found, docs).collect()}
    assert shares["none"] == 400 - len({d for d, _ in got})
    assert subjects.document_subjects(docs.limit(0), labels, areas).count() == 0


# ------------------------------------------------------------------- queries


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_runs_with_its_columns(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    columns = {"p1_found": ["id", "cut"], "p2_found": ["field", "id_a", "id_b"], "p3_found": ["id", "defect"], "p4_found": ["traj_id", "first_ord", "last_ord"],
               "p5_found": ["id"], "p6_found": ["doc_id"], "p7_found": ["mix_id", "source"], "p8_found": ["doc_id", "subject"]}
    if name in columns:
        assert got.columns == columns[name]
        rows = got.collect()
        assert rows and len(rows) == len(set(rows))
    else:
        assert got.count() > 0
