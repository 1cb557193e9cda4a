"""Traces of one workflow scored many at a time: what :func:`trailmark.operators.traces.score_trace` gives, without its reports.

The tables of path search and alignment have a column per window. A window that
no part of the workflow resembles leaves each row of either table as it is in
the column before, so only the others are columns here; the tables of many
traces then lie side by side in arrays whose last axis is the trace.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from typing import Any

import numpy as np

from trailmark.operators.align import ScorerConfig
from trailmark.operators.embed import Cached
from trailmark.operators.windows import DELIMITERS, kept, spans
from trailmark.operators.workflow import Machine, Validator, WorkflowConfig, _unrolled, contract, machine, state_of

#: Cells of a table's row over all traces that are scored at once; and characters of their texts.
CELLS, CHARS = 16_384, 400_000
#: Windows whose similarities are kept.
KEPT = 80_000
#: Longer texts are cut alone.
LONG = 20_000
#: What :meth:`Batch.reward` gives.
FIELDS = ["score", "required_coverage", "order_rate", "state_score", "best_path"]
#: Less than any rounding of a threshold; more columns than needed give the same.
SLACK = 1e-5


def blocks(sizes: list[int], order: list[int], most: int) -> Iterator[list[int]]:
    """Stretches of ``order`` whose number times largest size is at most ``most``; one item may be larger."""
    own: list[int] = []
    top = 0
    for i in order:
        if own and max(top, sizes[i]) * (len(own) + 1) > most:
            yield own
            own, top = [], 0
        own.append(i)
        top = max(top, sizes[i])
    if own:
        yield own


def stretches(sizes: list[int], most: int, total: int) -> Iterator[slice]:
    """Neighbours of at most ``most`` items and ``total`` size; one item may be larger."""
    first = own = 0
    for i, n in enumerate(sizes):
        if i > first and (i - first >= most or own + n > total):
            yield slice(first, i)
            first, own = i, 0
        own += n
    if len(sizes) > first:
        yield slice(first, len(sizes))


def cut(texts: list[str], size: tuple[int, int], cap: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Trace, start and end of the kept windows of stripped texts, in order; positions are those in the joined texts."""
    window, stride = size
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    stops = np.cumsum(lengths)
    begins = stops - lengths
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    delimiter = np.zeros(len(code), dtype=bool)
    for c in DELIMITERS:
        delimiter |= code == ord(c)
    last = np.maximum.accumulate(np.where(delimiter, np.arange(len(code)), -1))
    at = np.flatnonzero((lengths > 0) & (lengths <= LONG))
    start, found = begins[at], []
    while len(at):
        stop = stops[at]
        end = np.minimum(start + window, stop)
        place = last[end - 1]
        # a cut in the first half would make the window too short
        end = np.where((end < stop) & (place > start + window // 2), place + 1, end)
        found.append((at, start, end))
        more = end < stop
        at, start = at[more], np.maximum(end - stride, start + 1)[more]
    for i in np.flatnonzero(lengths > LONG).tolist():
        own = np.array(spans(texts[i], window, stride), dtype=np.int64) + begins[i]
        found.append((np.full(len(own), i), own[:, 0], own[:, 1]))
    if not found:
        return (np.zeros(0, dtype=np.int64),) * 3
    at, start, end = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.argsort(at, kind="stable")
    counts = np.bincount(at, minlength=len(texts))
    if counts.max() > cap:
        first = np.cumsum(counts) - counts
        order = order[np.concatenate([first[i] + np.array(kept(n, cap), dtype=np.int64) for i, n in enumerate(counts.tolist())])]
    return at[order], start[order], end[order]


class Parts:
    """The parts of a workflow's contracts as rows, and its unrolled machine as arrays."""

    def __init__(self, spec: str, config: WorkflowConfig) -> None:
        self.m, self.g = machine(spec), _unrolled(spec, config)
        m, g = self.m, self.g
        self.keys = [(n, p) for n in m.nodes for p, _ in contract(m, n, config)]
        self.row = {k: i for i, k in enumerate(self.keys)}
        self.texts = [m.nodes[n][p] for n, p in self.keys]
        weights = [(m.nodes[n]["weight"], w, m.nodes[n]["required"]) for n in m.nodes for _, w in contract(m, n, config)]
        self.priority = np.array([x * w * (1.0 if r else 1e-6) for x, w, r in weights])
        phases: list[tuple[int, str, float]] = []
        first, last = [], []
        for s, node in enumerate(g.node):
            first.append(len(phases))
            phases += [(s, p, w) for p, w in contract(m, node, config) or [("action", 1.0)]]
            last.append(len(phases) - 1)
        self.state = np.array([s for s, _, _ in phases])
        self.key = np.array([self.row[g.node[s], p] for s, p, _ in phases])
        self.first, self.last = np.array(first), np.array(last)
        #: What a hit and a visit count, if the node is required.
        self.hit = np.array([m.nodes[g.node[s]]["weight"] * w if m.nodes[g.node[s]]["required"] else 0.0 for s, _, w in phases])
        self.visit = np.array([m.nodes[n]["weight"] if m.nodes[n]["required"] else 0.0 for n in g.node])
        self.parents = np.zeros((len(g.node), max(1, *map(len, g.parents))), dtype=np.int64)
        for s, own in enumerate(g.parents):
            self.parents[s, : len(own)] = [p for p, _ in own]


@lru_cache(maxsize=256)
def parts(spec: str, config: WorkflowConfig) -> Parts:
    return Parts(spec, config)


class Route:
    """What of a path's nodes is asked of a text: its required parts in order."""

    def __init__(self, p: Parts, nodes: tuple[str, ...], config: WorkflowConfig) -> None:
        m, count = p.m, Counter()
        self.visits: list[tuple[dict[str, Any], int, str]] = []
        for n in nodes:
            count[n] += 1
            if m.nodes[n]["required"]:
                self.visits.append((m.nodes[n], count[n], f"{n}#{count[n]}"))
        self.weights = [[w for _, w in contract(m, v["id"], config)] for v, _, _ in self.visits]
        self.rows = [p.row[v["id"], part] for v, _, _ in self.visits for part, _ in contract(m, v["id"], config)]
        if not self.rows:
            raise ValueError("a legal path has no required contract")
        asked = [tuple(c.lower() for c in p.texts[r]) for r in self.rows]
        many = Counter(asked)
        self.repeated = [many[k] > 1 for k in asked]
        self.conditioned = [v for v in self.visits if v[0]["preconditions"] or v[0]["postconditions"]]
        self.m, self.known = m, {}

    def coverage(self, hits: list[bool]) -> float:
        """The required coverage of the parts that were hit."""
        key = bytes(hits)
        if key not in self.known:
            stages: dict[str, list[tuple[float, float]]] = {}
            at = 0
            for (node, _, _), weights in zip(self.visits, self.weights, strict=True):
                score = sum(w for w, hit in zip(weights, hits[at : at + len(weights)], strict=True) if hit)
                at += len(weights)
                stages.setdefault(node["stage"] or "default", []).append((score, node["weight"]))
            share = {s: sum(x * w for x, w in v) / sum(w for _, w in v) for s, v in sorted(stages.items())}
            weigh = {s: self.m.stage_weights.get(s, sum(w for _, w in stages[s])) for s in share}
            self.known[key] = sum(share[s] * w for s, w in weigh.items()) / sum(weigh.values())
        return self.known[key]


class Batch:
    """Scores texts of one workflow; keeps the similarities of windows it has met."""

    def __init__(self, scorer: ScorerConfig, config: WorkflowConfig, validator: Validator | None = None) -> None:
        self.scorer, self.config, self.validator = scorer, config, validator
        self.instructions = getattr(scorer.encoder, "instructions", {})
        self.asked: dict[str, np.ndarray] = {}
        self.routes: dict[tuple[str, tuple[str, ...]], Route] = {}
        self._clear()

    def _clear(self) -> None:
        self.kept: dict[str, dict[str, int]] = {}
        self.sims: dict[str, np.ndarray] = {}

    def similarities(self, spec: str, texts: list[str]) -> np.ndarray:
        """Windows x parts, the best candidate of each part counting."""
        p = parts(spec, self.config)
        if spec not in self.asked:
            flat = [c for t in p.texts for c in t]
            self.asked[spec] = Cached(self.scorer.encoder, len(flat)).encode(flat, ["query"] * len(flat))
        if sum(map(len, self.kept.values())) > KEPT:
            self._clear()
        seen = self.kept.setdefault(spec, {})
        rows = list(map(seen.get, texts))
        new = list(dict.fromkeys(t for t, r in zip(texts, rows, strict=True) if r is None)) if None in rows else []
        if new:
            before = self.instructions.get("passage", "")
            starts = np.cumsum([0, *map(len, p.texts[:-1])])
            asked, fresh = self.asked[spec].astype(np.float64), np.empty((len(new), len(p.keys)), dtype=np.float32)
            for at in range(0, len(new), 4096):
                vectors = self.scorer.encoder.encode([before + t for t in new[at : at + 4096]])
                # in single precision equal similarities would differ by the shape of the product, and with them the first of the best windows
                every = (asked @ vectors.T.astype(np.float64)).astype(np.float32)
                fresh[at : at + 4096] = np.maximum.reduceat(every, starts, axis=0).T
            seen |= zip(new, range(len(seen), len(seen) + len(new)), strict=True)
            old, have = self.sims.get(spec), len(seen)
            if old is None or have > len(old):
                self.sims[spec] = grown = np.empty((max(2 * have, 1024), len(p.keys)), dtype=np.float32)
                if old is not None:
                    grown[: have - len(new)] = old[: have - len(new)]
            self.sims[spec][have - len(new) : have] = fresh
            rows = list(map(seen.get, texts))
        return self.sims[spec][rows] if rows else np.zeros((0, len(p.keys)), dtype=np.float32)

    def _columns(self, spec: str, texts: list[str], size: tuple[int, int], threshold: float) -> tuple[np.ndarray, np.ndarray]:
        """Per text the number of windows that resemble some part, and those windows' similarities, text by text."""
        at, start, end = cut(texts, size, self.scorer.max_windows)
        whole = "".join(texts)
        sim = self.similarities(spec, [whole[s:e] for s, e in zip(start.tolist(), end.tolist(), strict=True)])
        some = sim.max(1, initial=-2.0) >= threshold - SLACK
        return np.bincount(at[some], minlength=len(texts)), sim[some]

    def score(self, spec: str, texts: list[str]) -> list[tuple[tuple[str, ...], float, float]]:
        """Best path, required coverage and order of each text."""
        out: list[Any] = [None] * len(texts)
        texts = [t.strip() for t in texts]
        c = self.scorer
        for block in stretches([len(t) for t in texts], len(texts), CHARS):
            block = range(len(texts))[block]
            some = [texts[i] for i in block]
            n_fine, fine = self._columns(spec, some, c.fine, c.threshold)
            n_coarse, coarse = self._columns(spec, some, c.coarse, c.threshold * 0.9) if c.coarse_to_fine else (np.zeros(len(some), dtype=np.int64), fine[:0])
            at_fine, at_coarse = np.cumsum(n_fine) - n_fine, np.cumsum(n_coarse) - n_coarse
            most = np.maximum(n_fine, n_coarse) + 1
            for group in blocks(most.tolist(), np.argsort(most, kind="stable").tolist(), CELLS):
                g = np.array(group)
                f, k = side_by_side(fine, at_fine[g], n_fine[g]), side_by_side(coarse, at_coarse[g], n_coarse[g])
                paths = self._paths(spec, f)
                for i, x in zip(group, self._aligned(spec, paths, f, k), strict=True):
                    out[block[i]] = x
        return out

    def _paths(self, spec: str, sim: np.ndarray) -> list[tuple[str, ...]]:
        """The nodes of each trace's best path; ``sim`` is parts x windows x traces. See :class:`trailmark.operators.workflow.PathTable`."""
        p = parts(spec, self.config)
        if not p.g.terminal:
            raise ValueError("no terminal can be reached within the limits")
        _, n, b = sim.shape
        double = sim.astype(np.float64)
        gains = np.where(double >= self.scorer.threshold, p.priority[:, None, None] * (1.0 + double * 1e-4), -np.inf)
        table = np.empty((len(p.key), n + 1, b))
        bases, origin = np.empty_like(table), np.zeros(table.shape, dtype=np.int16)
        for k, (s, key) in enumerate(zip(p.state.tolist(), p.key.tolist(), strict=True)):
            if k > p.first[s]:
                bases[k] = table[k - 1]
            elif s == 0:
                bases[k] = 0.0
            else:
                own = [table[p.last[x]] for x, _ in p.g.parents[s]]
                bases[k] = own[0]
                for i, other in enumerate(own[1:], 1):  # the first of the largest
                    origin[k][other > bases[k]] = i
                    np.maximum(bases[k], other, out=bases[k])
            best = table[k]
            best[0] = bases[k][0]
            np.maximum(bases[k][1:], bases[k][:-1] + gains[key], out=best[1:])
            np.maximum.accumulate(best, axis=0, out=best)
        # every terminal of every trace is walked back at once
        ends = np.array(p.g.terminal)
        trace = np.tile(np.arange(b), len(ends))
        k, j = np.repeat(p.last[ends], b), np.full(len(trace), n)
        live = np.arange(len(trace))
        hits, states = [], [np.repeat(ends, b)]
        while len(live):
            kk, jj, t = k[live], j[live], trace[live]
            some, before = jj > 0, np.maximum(jj - 1, 0)
            left = np.where(some, table[kk, before, t], -np.inf)
            base = bases[kk, jj, t]
            match = np.where(some, bases[kk, before, t] + gains[p.key[kk], np.minimum(before, n - 1), t], -np.inf) if n else np.full(len(live), -np.inf)
            hit = some & (match > -np.inf) & (match >= np.maximum(left, base))
            back = ~hit & some & ~(base > left)
            found = np.full(len(trace), -1)
            found[live[hit]] = kk[hit]
            hits.append(found)
            jj = np.where(hit | back, before, jj)
            at = p.state[kk]
            inner, opening = ~back & (kk > p.first[at]), ~back & (kk == p.first[at])
            up = p.parents[at, origin[kk, jj, t]]
            moved = opening & (at > 0)
            came = np.full(len(trace), -1)
            came[live[moved]] = up[moved]
            states.append(came)
            k[live], j[live] = np.where(inner, kk - 1, np.where(moved, p.last[up], kk)), jj
            live = live[~(opening & (at == 0))]
        # sums run along the path, as those of one trace do
        got, whole = np.zeros(len(trace)), np.zeros(len(trace))
        for found in reversed(hits):
            got += np.where(found >= 0, p.hit[found], 0.0)
        for came in reversed(states):
            whole += np.where(came >= 0, p.visit[came], 0.0)
        cover = np.divide(got, whole, out=np.zeros_like(got), where=whole > 0).reshape(len(ends), b)
        value, depth = table[p.last[ends], n], -np.array(p.g.depth)[ends]
        chosen = np.zeros(b, dtype=np.int64)
        every = np.arange(b)
        for i in range(1, len(ends)):
            c, v, d = cover[chosen, every], value[chosen, every], depth[chosen]
            better = (cover[i] > c) | ((cover[i] == c) & ((value[i] > v) | ((value[i] == v) & (depth[i] > d))))
            chosen[better] = i
        walked = np.stack(states[::-1])[:, chosen * b + every].T.tolist()
        return [tuple(p.g.node[s] for s in own if s >= 0) for own in walked]

    def _aligned(self, spec: str, paths: list[tuple[str, ...]], fine: np.ndarray, coarse: np.ndarray) -> list[tuple[tuple[str, ...], float, float]]:
        """Path, required coverage and order of each trace: on coarse windows, and on fine ones where steps are missing."""
        p, c = parts(spec, self.config), self.scorer
        routes = []
        for nodes in paths:
            if (spec, nodes) not in self.routes:
                self.routes[spec, nodes] = Route(p, nodes, self.config)
            routes.append(self.routes[spec, nodes])
        steps = max(len(r.rows) for r in routes)
        rows, repeated = np.full((len(routes), steps), -1), np.zeros((len(routes), steps), dtype=bool)
        for i, r in enumerate(routes):
            rows[i, : len(r.rows)], repeated[i, : len(r.rows)] = r.rows, r.repeated
        sizes = (rows >= 0).sum(1)
        if c.coarse_to_fine:
            hit, order = aligned(coarse, rows, repeated, c.threshold * 0.9)
            rate = hit.sum(1) / sizes
            more = np.flatnonzero(rate < 1.0)
        else:
            hit, order = np.zeros(rows.shape, dtype=bool), np.zeros(len(rows))
            rate, more = np.full(len(rows), -1.0), np.arange(len(rows))
        if len(more):
            hit_fine, order_fine = aligned(fine[:, :, more], rows[more], repeated[more], c.threshold)
            no_fewer = hit_fine.sum(1) / sizes[more] >= rate[more]
            hit[more[no_fewer]], order[more[no_fewer]] = hit_fine[no_fewer], order_fine[no_fewer]
        return [(nodes, r.coverage(h[:n]), o) for nodes, r, h, n, o in zip(paths, routes, hit.tolist(), sizes.tolist(), order.tolist(), strict=True)]

    def reward(self, spec: str, nodes: tuple[str, ...], required: float, order: float, seen: dict[str, Any]) -> dict[str, Any]:
        """What a path's coverage and order are worth; see :func:`trailmark.operators.workflow.reward`."""
        config, route = self.config, self.routes[spec, nodes]
        final, state = required * order, None
        if route.conditioned and (seen or config.require_states):
            met = [state_of(node, key, n, seen, self.validator)[0] for node, n, key in route.conditioned]
            state = sum(x or 0.0 for x in met) / len(met)
            final = 0.0 if config.hard_state_gate and not all(x == 1.0 for x in met) else final * (1 - config.state_weight + config.state_weight * state)
        return {"score": final, "required_coverage": required, "order_rate": order, "state_score": state, "best_path": list(nodes)}


def side_by_side(rows: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Parts x windows x traces of rows that lie trace by trace; what a trace lacks resembles nothing."""
    place = np.arange(n.max(initial=0))[:, None]
    have = place < n
    if not len(rows):
        return np.full((rows.shape[1], *have.shape), -2.0, dtype=np.float32)
    out = rows[np.where(have, at + place, 0)]
    out[~have] = -2.0
    return np.ascontiguousarray(out.transpose(2, 0, 1))


def aligned(sim: np.ndarray, rows: np.ndarray, repeated: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Which steps are matched, and their order; ``sim`` is parts x windows x traces, ``rows`` traces x steps, -1 behind the last.

    The table and its moves are those of :func:`trailmark.operators.align.align`.
    """
    b, steps = rows.shape
    n = sim.shape[1]
    if not n:
        return np.zeros(rows.shape, dtype=bool), np.zeros(b)
    every = np.arange(b)
    own = sim[rows.T[:, None, :], np.arange(n)[None, :, None], every]
    own[np.broadcast_to((rows.T < 0)[:, None, :], own.shape)] = -2.0
    gain = np.where(own >= np.float32(threshold), own, np.float32(0))
    table = np.zeros((steps + 1, n + 1, b), dtype=np.float32)
    for i in range(steps):
        g, above = gain[i], table[i]
        matched = above[:-1] + g
        best = np.where((g > 0) & (matched > above[1:]), matched, above[1:])
        np.maximum.accumulate(best, axis=0, out=table[i + 1, 1:])
    placed = np.full((b, steps), -1)
    i, j, live = np.full(b, steps), np.full(b, n), every
    while len(live):
        ii, jj = i[live], j[live]
        g, up, left = gain[ii - 1, jj - 1, live], table[ii - 1, jj, live], table[ii, jj - 1, live]
        diagonal = table[ii - 1, jj - 1, live] + g
        hit = (g > 0) & (diagonal >= left) & (diagonal >= up)
        placed[live[hit], ii[hit] - 1] = jj[hit] - 1
        back = hit | (left >= up)
        i[live], j[live] = ii - (hit | ~back), jj - back
        live = live[(i[live] > 0) & (j[live] > 0)]
    best, where = own.max(1).T, own.argmax(1).T
    told = best.astype(np.float64) >= threshold
    at = np.where(repeated & (placed >= 0), placed, where)
    order = told.sum(1).astype(np.float64)
    many = np.flatnonzero(order > 1)
    for x in np.array_split(many, 1 + len(many) * steps * steps // 4_000_000) if len(many) else []:
        both = np.triu(told[x][:, :, None] & told[x][:, None, :], 1)
        a, z = at[x][:, :, None], at[x][:, None, :]
        order[x] = (((a < z) + 0.5 * (a == z)) * both).sum((1, 2)) / both.sum((1, 2))
    return placed >= 0, order
