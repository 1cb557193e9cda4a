"""Scores of runtime traces: validated, rendered, aligned with their workflow, gated.

A trace is a list of events that comes as one row: the events of an attempt, or
those that a training row carries. Trajectories of any length are cut into
attempts first (:func:`attempts`), so no row grows with the data.
"""

from __future__ import annotations

import json
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace
from itertools import groupby, pairwise
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from trailmark.functions import text as X
from trailmark.functions.payloads import decoded, redacted
from trailmark.operators import batches
from trailmark.operators.align import ScorerConfig
from trailmark.operators.embed import Cached
from trailmark.operators.events import SOURCES, STATUSES, ValidationConfig
from trailmark.operators.sequences import running, with_previous
from trailmark.operators.workflow import REWARD, Machine, Validator, WorkflowConfig, machine, prefix_coverage, score_workflow
from trailmark.plans.sizing import broadcast_if_small

#: Events of one attempt at most; what follows is another one.
MAX_EVENTS = 1_000
#: Nodes of all workflows up to which they travel with the code.
MAX_NODES = 10_000
#: Traces, and characters of their events, that are scored together.
TOGETHER, TOGETHER_CHARS = 1_500, 6_000_000
#: What an event has, payloads as JSON text.
FIELDS = ["event_id", "action", "node_id", "occurrence", "evidence", "outcome", "status", "source", "trusted", "transition_kind", "tool_name", "tool_input", "tool_output", "state_before", "state_after", "metadata"]


def _text(value: Any) -> str | None:
    return (str(value).strip() or None) if value is not None else None


def parsed(events: Iterable[dict[str, Any]], *, allow_trust: bool = True) -> list[dict[str, Any]]:
    """Events with tidy texts and decoded payloads; raises if one breaks the schema."""
    out = []
    for i, raw in enumerate(events):
        e = {f: raw.get(f) for f in FIELDS}
        e["event_id"] = _text(raw.get("event_id", raw.get("id", f"event-{i}")))
        e["tool_name"] = _text(raw.get("tool_name", raw.get("tool")))
        e |= {f: _text(e[f]) for f in ("action", "node_id", "evidence", "outcome", "transition_kind")}
        e |= {"status": (_text(e["status"]) or "success").lower(), "source": (_text(e["source"]) or "model").lower()}
        e["transition_kind"] = e["transition_kind"].lower() if e["transition_kind"] else None
        e["trusted"] = bool(allow_trust and e["trusted"])
        e |= {f: decoded(e[f]) if isinstance(e[f], str) else e[f] for f in ("tool_input", "tool_output", "state_before", "state_after", "metadata")}
        e |= {f: e[f] if isinstance(e[f], dict) else {} for f in ("state_before", "state_after")}
        bad = [name for name, wrong in (
            ("event_id", not e["event_id"]), ("action", not e["action"]), ("occurrence", e["occurrence"] is not None and int(e["occurrence"]) <= 0),
            ("status", e["status"] not in STATUSES), ("source", e["source"] not in SOURCES)) if wrong]
        if bad:
            raise ValueError(f"event {i} has no valid {', '.join(bad)}")
        out.append(e)
    return out


@dataclass
class Walk:
    """What a trace did in its workflow, and every check with what its failing says."""

    visits: list[tuple[str, int, list[dict[str, Any]]]]
    edges: list[dict[str, Any]]
    checks: list[tuple[bool, str]]
    warnings: list[str]
    mapped: int
    trusted: int
    total: int
    reached: bool

    @property
    def path(self) -> list[str]:
        return [node for node, _, _ in self.visits]

    @property
    def violations(self) -> list[str]:
        """What failed, each once, in the order of the checks."""
        return list(dict.fromkeys(reason for ok, reason in self.checks if not ok))

    @property
    def validity(self) -> float:
        return sum(ok for ok, _ in self.checks) / len(self.checks) if self.checks else 0.0

    @property
    def states(self) -> dict[str, dict[str, Any]]:
        """By visit the first state before and the last after; visits without states have none."""
        out = {}
        for node, occurrence, events in self.visits:
            before = next((e["state_before"] for e in events if e["state_before"]), {})
            after = next((e["state_after"] for e in reversed(events) if e["state_after"]), {})
            if before or after:
                out[f"{node}#{occurrence}"] = {"before": before, "after": after}
        return out

    def summary(self) -> dict[str, Any]:
        """The columns of TRACE."""
        return {
            "valid": not self.violations, "validity": self.validity, "violations": self.violations, "warnings": self.warnings, "node_path": self.path,
            "occurrence_path": [f"{node}#{n}" for node, n, _ in self.visits], "edge_kinds": [e["kind"] for e in self.edges], "terminal_reached": self.reached,
            "mapped_events": self.mapped, "trusted_events": self.trusted, "total_events": self.total, "checks_passed": sum(ok for ok, _ in self.checks), "checks_total": len(self.checks),
        }


def numbered(events: list[dict[str, Any]], nodes: Iterable[str]) -> Iterator[tuple[str, int, dict[str, Any]]]:
    """Events of known nodes with their occurrence, given or inferred."""
    top: Counter = Counter()
    here: tuple[str, int] | None = None
    for e in events:
        node = e["node_id"]
        if node in nodes:
            number = e["occurrence"]
            if number is None:
                number = here[1] if here and here[0] == node else top[node] + 1
            here = (node, number)
            top[node] = max(top[node], number)
            yield node, number, e


def walk(events: list[dict[str, Any]], m: Machine, config: ValidationConfig) -> Walk:
    """Hold parsed events against a workflow: the same checks as :func:`trailmark.operators.events.checks`, for one trace."""
    believed = [e["trusted"] and e["source"] in config.trusted_sources for e in events]
    checks = [(len({e["event_id"] for e in events}) == len(events), "duplicate_event_id")]
    if config.require_trusted:
        checks += [(ok, f"untrusted_event:{e['event_id']}") for ok, e in zip(believed, events, strict=True)]
    for e in events:
        if e["node_id"] is None:
            checks += [(False, f"missing_node_id:{e['event_id']}")] * config.require_node_ids
        else:
            checks.append((e["node_id"] in m.nodes, f"unknown_node:{e['node_id']}"))
    visits = [(node, n, [e for _, _, e in own]) for (node, n), own in groupby(numbered(events, m.nodes), key=lambda x: x[:2])]
    if not visits:
        checks.append((False, "no_mapped_workflow_path"))
    elif config.require_start:
        checks.append((visits[0][0] == m.start, f"wrong_start:{visits[0][0]}"))
    times: Counter = Counter()
    for node, n, _ in visits:
        times[node] += 1
        checks.append((n == times[node], f"non_sequential_occurrence:{node}:{n}!={times[node]}"))
    checks += [(n <= m.nodes[node]["max_visits"], f"node_visit_limit_exceeded:{node}:{n}>{m.nodes[node]['max_visits']}") for node, n in times.items()]
    taken: Counter = Counter()
    edges, warnings = [], []
    for (left, _, _), (right, n, own) in pairwise(visits):
        kinds = sorted({e["transition_kind"] for e in own if e["transition_kind"]})
        checks.append((len(kinds) <= 1, f"conflicting_transition_kinds:{right}#{n}"))
        options = [k for k in m.out[left] if m.edges[k]["target"] == right and (not kinds or m.edges[k]["kind"] == kinds[0])]
        if not options:
            checks.append((False, f"illegal_transition:{left}->{right}" + "".join(f":{k}" for k in kinds[:1])))
            continue
        if len(options) > 1 and not kinds:
            warnings.append(f"ambiguous_transition:{left}->{right}")
        taken[options[0]] += 1
        edge = m.edges[options[0]]
        edges.append(edge)
        checks.append((taken[options[0]] <= edge["max_traversals"], f"edge_traversal_limit_exceeded:{left}->{right}:{taken[options[0]]}>{edge['max_traversals']}"))
    reached = bool(visits) and visits[-1][0] in m.terminals
    if config.require_terminal:
        checks.append((reached, f"terminal_not_reached:{visits[-1][0] if visits else '<none>'}"))
    return Walk(visits, edges, checks, warnings, sum(e["node_id"] is not None for e in events), sum(believed), len(events), reached)


_JSON = json.JSONEncoder(ensure_ascii=False, sort_keys=True)
_HEAD = [("id=", "event_id"), ("source=", "source"), ("status=", "status"), ("node=", "node_id"), ("occurrence=", "occurrence"), ("transition=", "transition_kind")]
_BODY = [("Action: ", "action"), ("Tool: ", "tool_name"), ("Tool input: ", "tool_input"), ("Evidence: ", "evidence"), ("Tool output: ", "tool_output"), ("Outcome: ", "outcome")]


def render(events: list[dict[str, Any]], limit: int = 2000) -> str:
    """Parsed events as the scorer reads them; see :func:`trailmark.operators.events.rendered`."""

    def shown(value: Any) -> str:
        text = value if isinstance(value, str) else _JSON.encode(value)
        return text if len(text) <= limit else text[:limit] + "…"

    out = []
    for e in events:
        head = " ".join([label + shown(e[f]) for label, f in _HEAD if e[f] is not None])
        out += [f"<trace_event {head}>", *[label + shown(e[f]) for label, f in _BODY if e[f] is not None], "</trace_event>"]
    return "\n".join(out)


def score_trace(encode, spec: str, events: list[dict[str, Any]], states: dict[str, Any] | None, scorer: ScorerConfig, config: WorkflowConfig, validation: ValidationConfig,
                validator: Validator | None = None) -> dict[str, Any]:
    """Reward of parsed events: their rendered text along the workflow, behind the validity of their trace.

    Given ``states`` go before those of the events. The nodes walked must be
    those the text tells of, all of them if a terminal was reached, else so far.
    """
    w = walk(events, machine(spec), validation)
    got = score_workflow(encode, spec, render(events, validation.max_field_chars), w.states | (states or {}), scorer, config, validator)
    return _gated(got, w, config)


def _gated(got: dict[str, Any], w: Walk, config: WorkflowConfig) -> dict[str, Any]:
    """A reward behind the validity of its trace, which must have walked what the text tells of."""
    told = got["best_path"] if w.reached else got["best_path"][: len(w.path)]
    if w.path and told != w.path:
        w.checks.append((False, f"semantic_path_mismatch:{'->'.join(w.path)}!={'->'.join(got['best_path'])}"))
    factor = 1.0 if not w.violations else 0.0 if config.hard_trace_gate else 1.0 - config.trace_weight + config.trace_weight * w.validity
    return got | {"score": got["score"] * factor, "trace": w.summary()}


def score_together(batch: batches.Batch, specs: list[str], payloads: list[str], validation: ValidationConfig) -> list[dict[str, Any]]:
    """:func:`score_trace` of many events as JSON, of its fields only those of :data:`trailmark.operators.batches.FIELDS` and ``trace``."""
    walks, own = [], {}
    for i, (spec, payload) in enumerate(zip(specs, payloads, strict=True)):
        events = parsed(json.loads(payload))
        w = walk(events, machine(spec), validation)
        states = w.states
        w.visits = [(node, n, []) for node, n, _ in w.visits]  # the events are not kept
        walks.append((w, states))
        own.setdefault(spec, []).append((i, render(events, validation.max_field_chars)))
    out: list[Any] = [None] * len(specs)
    for spec, mine in own.items():
        for (i, _), (nodes, required, order) in zip(mine, batch.score(spec, [text for _, text in mine]), strict=True):
            w, states = walks[i]
            out[i] = _gated(batch.reward(spec, nodes, required, order, states), w, batch.config)
    return out


TRACE = T.StructType(
    [T.StructField("valid", T.BooleanType()), T.StructField("validity", T.DoubleType())]
    + [T.StructField(n, T.ArrayType(T.StringType())) for n in ("violations", "warnings", "node_path", "occurrence_path", "edge_kinds")]
    + [T.StructField("terminal_reached", T.BooleanType())]
    + [T.StructField(n, T.IntegerType()) for n in ("mapped_events", "trusted_events", "total_events", "checks_passed", "checks_total")]
)
TRACE_REWARD = T.StructType([*REWARD.fields, T.StructField("trace", TRACE)])


# ------------------------------------------------------------------- tables


def attempts(events: DataFrame, known: DataFrame, defs: DataFrame, *, max_events: int = MAX_EVENTS, single: bool = False) -> DataFrame:
    """``traj_id, ord, workflow, attempt, part``: each event's passage through its workflow.

    ``known`` is :func:`trailmark.operators.events.known_events` of ``events``.
    An attempt begins where the start node is entered; events without a known
    node belong to the attempt they stand in, those of an undefined workflow to
    none. What goes beyond ``max_events`` events, more than any bounded path
    has, is another ``part`` of it.
    """
    starts = broadcast_if_small(defs.select(F.col("name").alias("w"), "start"))
    linked = with_previous(known.join(starts, F.col("workflow") == F.col("w")), "traj_id", "ord", ["node_id"], single=single)
    entered = linked.filter((F.col("node_id") == F.col("start")) & (~F.col("has_prev") | (F.col("prev_node_id") != F.col("node_id"))))
    entered = entered.select(F.col("traj_id").alias("t"), F.col("ord").alias("o"))
    every = events.select("traj_id", "ord", "workflow").join(starts.select("w"), F.col("workflow") == F.col("w"), "left_semi")
    marked = every.join(entered, (F.col("traj_id") == F.col("t")) & (F.col("ord") == F.col("o")), "left")
    cut = running(marked, ["traj_id"], "ord", "attempt", "sum", F.col("o").isNotNull().cast("long"), single=single).select("traj_id", "ord", "workflow", "attempt")
    placed = running(cut, ["traj_id", "attempt"], "ord", "nth", "sum", F.lit(1).cast("long"), single=single)
    return placed.select("traj_id", "ord", "workflow", "attempt", F.floor((F.col("nth") - 1) / max_events).alias("part"))


def collected_events(events: DataFrame, keys: DataFrame) -> DataFrame:
    """``traj_id, workflow, attempt, part, trace``: the events of every part of :func:`attempts` as one ordered array."""
    k = keys.select(F.col("traj_id").alias("t"), F.col("ord").alias("o"), F.col("workflow").alias("wf"), "attempt", "part")
    both = events.join(k, (F.col("traj_id") == F.col("t")) & (F.col("ord") == F.col("o"))).drop("workflow")
    row = F.struct("ord", *[F.col(f) if f not in ("status", "source") else F.coalesce(f, F.lit("success" if f == "status" else "model")).alias(f) for f in FIELDS])
    spark = events.sparkSession
    # few bytes but much work per attempt: a number of tasks of one's own, which the grouping then has for nothing
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # at most MAX_EVENTS events come together
    own = both.select("traj_id", F.col("wf").alias("workflow"), "attempt", "part", row.alias("event")).repartition(tasks, "traj_id", "workflow", "attempt", "part")
    return own.groupBy("traj_id", "workflow", "attempt", "part").agg(F.array_sort(F.collect_list("event")).alias("trace"))


def cut_events(raw: DataFrame, nodes: DataFrame, defs: DataFrame, *, max_events: int = MAX_EVENTS) -> DataFrame | None:
    """What :func:`collected_events` gives for :func:`trailmark.operators.events.current_events`, ``trace`` as JSON text, in one shuffle.

    Rows of a trajectory meet in order and are walked once: of a place the
    latest delivery counts, the workflow is the one most events name, attempts
    and parts are those of :func:`attempts`. A trajectory is held in memory, so
    this is for those within one chunk (:mod:`trailmark.operators.sequences`).
    None if the workflows' tables are no small ones.
    """
    starts, known = defs.select("name", "start").limit(MAX_NODES + 1).collect(), nodes.select("workflow", "id").limit(MAX_NODES + 1).collect()
    flows = {r["name"]: (r["start"], {n["id"] for n in known if n["workflow"] == r["name"]}) for r in starts if r["name"] is not None}
    if len(known) > MAX_NODES or len(flows) < len(starts):
        return None
    cols = [F.col(f"`{c}`") for c in raw.columns]
    tidy = {c: X.optional(F.col(c)) for c in ("node_id", "transition_kind")} | {"status": F.coalesce("status", F.lit("success")), "source": F.coalesce("source", F.lit("model"))}
    used = [f for f in FIELDS if f != "metadata"]  # which nothing but the workflow's name is read of
    spark = raw.sparkSession
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = raw.filter("traj_id is not null and ord is not null").select(
        F.xxhash64("traj_id").alias("__t"), "traj_id", "ord", "ingested_at", F.xxhash64(*cols).alias("__h"), F.get_json_object("metadata", "$.workflow").alias("__w"), *used
    )
    # the hash goes first because names differ behind what a sort compares at once
    met = rows.repartition(tasks, "__t").sortWithinPartitions("__t", "traj_id", "ord", "ingested_at", "__h")
    tidied = met.withColumns({c: e for c, e in tidy.items()})
    ready = tidied.select("traj_id", "ord", "__w", "node_id", F.to_json(F.struct("ord", *used)).alias("__e"))
    schema = T.StructType([raw.schema["traj_id"], T.StructField("workflow", T.StringType()), T.StructField("attempt", T.LongType()), T.StructField("part", T.LongType()), T.StructField("trace", T.StringType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def one(name: str, own: list[tuple[int, str | None, str | None, str]]) -> Iterator[tuple]:
        own = [x for x, after in zip(own, [*own[1:], (None,)], strict=True) if x[0] != after[0]]
        told = Counter(w for _, w, _, _ in own if w is not None)
        workflow = min(told, key=lambda w: (-told[w], w), default=None)
        if workflow not in flows:
            return
        start, ids = flows[workflow]
        attempt, before, some = 0, None, []
        for _, _, node, e in own:
            entered = node in ids and node == start and before != node
            before = node if node in ids else before
            if some and entered:
                yield from ((name, workflow, attempt, k // max_events, f"[{','.join(some[k : k + max_events])}]") for k in range(0, len(some), max_events))
                some = []
            attempt += entered
            some.append(e)
        yield from ((name, workflow, attempt, k // max_events, f"[{','.join(some[k : k + max_events])}]") for k in range(0, len(some), max_events))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = lambda found: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names=schema.names)
        here, own = None, []
        for batch in batches:
            found: list[tuple] = []
            for name, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if name != here:
                    found += one(here, own) if own else []
                    here, own = name, []
                own.append(row)
            if found:
                yield made(found)
        if own and (found := list(one(here, own))):
            yield made(found)

    return ready.mapInArrow(run, schema)


def _per_trace(traces: DataFrame, keep: list[str], specs: DataFrame, more: list[T.StructField], rows, *, together: bool = False) -> DataFrame:
    """``keep`` and the columns ``more`` of each tuple that ``rows`` yields for an encoder-making call, a specification and raw events.

    Traces without a specification give no row. If ``together``, ``rows`` takes lists of specifications and of JSON and yields a list for each.
    """
    ready = traces.select(*keep, (F.col("trace") if isinstance(traces.schema["trace"].dataType, T.StringType) else F.to_json("trace")).alias("__e"), F.col("workflow").alias("__w"))
    joined = ready.join(broadcast_if_small(specs.select(F.col("workflow").alias("__wf"), "spec")), F.col("__w") == F.col("__wf")).drop("__w", "__wf")
    schema, k = T.StructType([*(traces.schema[c] for c in keep), *more]), len(keep)
    kinds = [to_arrow_type(f.dataType) for f in more]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = rows()
        for batch in batches:
            payloads, own = batch.column(k).to_pylist(), batch.column(k + 1).to_pylist()
            each = one(own, payloads) if together else (one(spec, json.loads(e)) for e, spec in zip(payloads, own, strict=True))
            found = [(i, *r) for i, those in enumerate(each) for r in those]
            at, *columns = list(zip(*found, strict=True)) or [()] * (1 + len(more))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(pa.array(at, pa.int32())) for i in range(k)), *(pa.array(c, t) for c, t in zip(columns, kinds, strict=True))], names=schema.names
            )

    return joined.mapInArrow(run, schema)


def validate_traces(traces: DataFrame, keep: list[str], specs: DataFrame, *, validation: ValidationConfig | None = None) -> DataFrame:
    """``keep`` and the struct ``trace`` of each row of :func:`collected_events` or :func:`cut_events`: how it fares in its workflow."""
    validation = validation or ValidationConfig()
    return _per_trace(traces, keep, specs, [T.StructField("trace", TRACE)], lambda: lambda spec, raw: [(walk(parsed(raw), machine(spec), validation).summary(),)])


def score_traces(traces: DataFrame, keep: list[str], specs: DataFrame, *, scorer: ScorerConfig | None = None, config: WorkflowConfig | None = None,
                 validation: ValidationConfig | None = None, validator: Validator | None = None, fields: list[str] | None = None) -> DataFrame:
    """``keep`` and the struct ``reward`` with its ``trace`` of each row of :func:`collected_events`.

    ``specs`` is :func:`trailmark.operators.workflow.packed`; rows whose
    workflow is not in it give no row. If no more than ``fields`` of the reward
    are asked for, some of :data:`trailmark.operators.batches.FIELDS`, the
    traces of an Arrow batch are scored together.
    """
    scorer, config, validation = scorer or ScorerConfig(), config or WorkflowConfig(), validation or ValidationConfig()
    if fields is not None and (not set(fields) <= set(batches.FIELDS) or config.mode != "graph"):
        raise ValueError(f"fields are some of {batches.FIELDS}, by graph")

    def rows():
        encode = Cached(scorer.encoder, scorer.cache_size).encode

        def one(spec: str, raw: list[dict[str, Any]]) -> list[tuple]:
            got = score_trace(encode, spec, parsed(raw), None, scorer, config, validation, validator)
            return [({n: got[n] for n in TRACE_REWARD.names},)]

        return one

    def many():
        batch = batches.Batch(scorer, config, validator)

        def each(own: list[str], payloads: list[str]) -> Iterator[list[tuple]]:
            sizes = [len(e) for e in payloads]
            for at in batches.stretches(sizes, TOGETHER, TOGETHER_CHARS):
                for got in score_together(batch, own[at], payloads[at], validation):
                    yield [({n: got[n] for n in [*fields, "trace"]},)]

        return each

    if fields is None:
        return _per_trace(traces, keep, specs, [T.StructField("reward", TRACE_REWARD)], rows)
    some = T.StructType([f for f in TRACE_REWARD.fields if f.name in [*fields, "trace"]])
    return _per_trace(traces, keep, specs, [T.StructField("reward", some)], many, together=True)


def event_potentials(traces: DataFrame, keep: list[str], specs: DataFrame, *, gamma: float = 1.0, scale: float = 1.0, scorer: ScorerConfig | None = None,
                     config: WorkflowConfig | None = None, validation: ValidationConfig | None = None) -> DataFrame:
    """``keep, ord, potential, shaped_reward, valid, validity``: how far each event carries its trace along the workflow.

    Each event is a passage; the potential is the coverage of the events so
    far. A beginning is held against the workflow without asking for its end.
    """
    if not 0 <= gamma <= 1 or scale < 0:
        raise ValueError("gamma must lie between 0 and 1 and scale must not be negative")
    scorer, config = scorer or ScorerConfig(), config or WorkflowConfig()
    validation = replace(validation or ValidationConfig(), require_terminal=False)

    def rows():
        encode = Cached(scorer.encoder, scorer.cache_size).encode

        def one(spec: str, raw: list[dict[str, Any]]) -> Iterator[tuple]:
            events, before = parsed(raw), 0.0
            potentials = prefix_coverage(encode, spec, [render([x], validation.max_field_chars) for x in events], scorer, config)
            for n, (x, p) in enumerate(zip(raw, potentials, strict=True), 1):
                w = walk(events[:n], machine(spec), validation)
                yield x["ord"], p, scale * (gamma * p - before), not w.violations, w.validity
                before = p

        return one

    more = [("ord", T.IntegerType()), ("potential", T.DoubleType()), ("shaped_reward", T.DoubleType()), ("valid", T.BooleanType()), ("validity", T.DoubleType())]
    return _per_trace(traces, keep, specs, [T.StructField(n, t) for n, t in more], rows)


def events_of(payload: str | None, *, redact: bool = False, allow_trust: bool = True) -> list[dict[str, Any]] | None:
    """Parsed events of a JSON array; null for anything else. ``redact`` hides what sensitive keys hold."""
    value = decoded(payload)
    if not isinstance(value, list):
        return None
    events = parsed(value, allow_trust=allow_trust)
    return [e | {f: redacted(e[f]) for f in ("tool_input", "tool_output", "metadata")} for e in events] if redact else events


def to_json(reward: Column) -> Column:
    """A reward as JSON text."""
    return F.to_json(reward, {"ignoreNullFields": "false"})
