"""Runtime events against the workflow they claim to follow.

Everything is windows, joins and aggregates: occurrences follow from a prefix
maximum (a visit adds one, an explicit number sets the least), visits are
islands of equal node and occurrence, transitions join neighbouring visits with
edges, and each rule gives check rows that are counted per trajectory.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.functions import text as X
from trailmark.functions.payloads import redact_json, stable_json
from trailmark.functions.tools import Call, Handler, handler_name, semantics
from trailmark.operators.sequences import in_parts, running, with_previous
from trailmark.plans.delivery import latest_delivery
from trailmark.plans.shared import write_shared
from trailmark.plans.sizing import broadcast_if_small

#: What an event may say of itself, and who is believed by default.
STATUSES = ["pending", "running", "success", "failure", "retrying", "recovered", "rolled_back", "skipped"]
SOURCES = ["runtime", "external", "model"]


@dataclass(frozen=True)
class ValidationConfig:
    require_trusted: bool = True
    trusted_sources: tuple[str, ...] = ("runtime", "external")
    require_node_ids: bool = True
    require_start: bool = True
    require_terminal: bool = True
    max_field_chars: int = 2000

    def __post_init__(self) -> None:
        if not self.trusted_sources or not set(self.trusted_sources) <= set(SOURCES):
            raise ValueError("trusted sources must be some of the known ones")
        if self.max_field_chars <= 0:
            raise ValueError("max_field_chars must be positive")


def current_events(raw: DataFrame) -> DataFrame:
    """Events with tidy texts, the latest delivery of each place, with the workflow of their trajectory.

    A trajectory's workflow is the one most of its events name (the smaller
    name on a tie). Rows without a trajectory or place are left out.
    """
    once = latest_delivery(raw.filter("traj_id is not null and ord is not null"), ["traj_id", "ord"], "ingested_at")
    named = F.get_json_object("metadata", "$.workflow").alias("wf")
    per = once.select("traj_id", named).filter("wf is not null").groupBy("traj_id", "wf").agg(F.count(F.lit(1)).alias("n"))
    # the smallest name of the largest count
    top = per.groupBy("traj_id").agg(F.min(F.struct(-F.col("n"), "wf"))["wf"].alias("workflow"))
    tidy = once.withColumns({"node_id": X.optional(F.col("node_id")), "transition_kind": X.optional(F.col("transition_kind"))})
    # every check reads the events again
    return write_shared(tidy.join(top, "traj_id", "left"), "events")


def known_events(events: DataFrame, nodes: DataFrame, *, single: bool = False) -> DataFrame:
    """Events whose node belongs to their workflow, with ``occ``, the given or inferred occurrence.

    Within a stretch of events of one node the first unnumbered event opens a
    new visit, later ones continue it; so a stretch maps the node's largest
    occurrence m to max(m + a, b), with a = 1 if it opens a visit and b the
    largest number given in it. Such maps compose to a running sum and a
    running maximum, which is what is computed. ``single`` says that every
    trajectory lies within one chunk (:mod:`trailmark.operators.sequences`).
    """
    # across chunks each prefix computation reads its input twice, so its input is a table
    table = (lambda df: df) if single else (lambda df: write_shared(df, "known"))
    ids = nodes.select(F.col("workflow").alias("w"), F.col("id").alias("i"))
    known = events.join(broadcast_if_small(ids), (F.col("workflow") == F.col("w")) & (F.col("node_id") == F.col("i")), "left_semi")
    base = table(known.select("traj_id", "ord", "workflow", "node_id", "occurrence", "transition_kind"))
    linked = with_previous(base, "traj_id", "ord", ["node_id"], single=single)
    opened = linked.withColumn("opens", (~F.col("has_prev")) | (F.col("prev_node_id") != F.col("node_id"))).drop("prev_node_id", "has_prev")
    first = table(opened.withColumn("a", (F.col("opens") & F.col("occurrence").isNull()).cast("long")))
    summed = table(running(first, ["traj_id", "node_id"], "ord", "sum_a", "sum", F.col("a"), single=single))
    below = F.coalesce(F.col("occurrence").cast("long") - F.col("sum_a"), F.lit(-(1 << 40)))
    peak = table(running(summed, ["traj_id", "node_id"], "ord", "peak", "max", below, single=single))
    opening = F.coalesce(F.col("occurrence").cast("long"), F.col("sum_a") + F.greatest(F.lit(0), "peak"))
    given = peak.withColumn("given", F.when(F.col("opens"), opening).otherwise(F.col("occurrence").cast("long"))).drop("a", "sum_a", "peak", "opens")
    # an unnumbered event repeats the last number of its stretch
    if single:
        w = Window.partitionBy("traj_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)
        return given.withColumn("occ", F.last("given", ignorenulls=True).over(w)).drop("given")
    marked = running(given, ["traj_id"], "ord", "at", "max", F.when(F.col("given").isNotNull(), F.col("ord").cast("long")))
    numbers = given.filter("given is not null").select(F.col("traj_id").alias("t"), F.col("ord").alias("o"), F.col("given").alias("occ"))
    return table(marked.join(numbers, (F.col("traj_id") == F.col("t")) & (F.col("at") == F.col("o"))).drop("t", "o", "at", "given"))


def _with_visits(known: DataFrame, single: bool) -> DataFrame:
    """``known`` with ``visit``, the number of the island of equal node and occurrence that an event lies in."""
    linked = with_previous(known, "traj_id", "ord", ["node_id", "occ"], single=single)
    fresh = (~F.col("has_prev")) | (F.col("prev_node_id") != F.col("node_id")) | (F.col("prev_occ") != F.col("occ"))
    return running(linked, ["traj_id"], "ord", "visit", "sum", fresh.cast("long"), single=single)


def visits(known: DataFrame, *, single: bool = False) -> DataFrame:
    """Islands of equal node and occurrence: ``traj_id, workflow, visit, node_id, occ, first_ord, n_events, kind, n_kinds``."""
    per = _with_visits(known, single).groupBy("traj_id", "workflow", "visit", "node_id", "occ").agg(
        F.min("ord").alias("first_ord"),
        F.count(F.lit(1)).alias("n_events"),
        F.min("transition_kind").alias("kind"),
        F.max("transition_kind").alias("__k"),
    )
    kinds = F.when(F.col("kind").isNull(), 0).when(F.col("kind") == F.col("__k"), 1).otherwise(2)
    out = per.withColumn("n_kinds", kinds).drop("__k")
    return out if single else write_shared(out, "visits")


def transitions(seen: DataFrame, edges: DataFrame, *, single: bool = False) -> DataFrame:
    """Neighbouring visits with the first edge that serves them: ``edge_index`` null if none does.

    A visit's requested kind restricts the edges (the smallest, if its events
    disagree). ``n_edges`` counts those that serve; ``taken`` is the running
    number of the edge's traversals.
    """
    pairs = with_previous(seen, "traj_id", "visit", ["node_id"], single=single).filter("has_prev")
    # a row per pair of nodes, with its edges in order
    e = edges.groupBy(F.col("workflow").alias("w"), "source", "target").agg(F.array_sort(F.collect_list(F.struct("edge_index", F.col("kind").alias("edge_kind"), "max_traversals"))).alias("served"))
    on = (F.col("workflow") == F.col("w")) & (F.col("prev_node_id") == F.col("source")) & (F.col("node_id") == F.col("target"))
    asked = F.filter("served", lambda x: F.col("kind").isNull() | (x["edge_kind"] == F.col("kind")))
    found = pairs.join(broadcast_if_small(e), on, "left").withColumn("served", F.coalesce(asked, F.array().cast(e.schema["served"].dataType)))
    keys = ["traj_id", "workflow", "visit", "prev_node_id", "node_id", "occ", "kind", "n_kinds"]
    chosen = found.select(*keys, F.size("served").cast("long").alias("n_edges"), F.get("served", F.lit(0)).alias("x")).select(*keys, "n_edges", "x.*")
    if not single:
        chosen = write_shared(chosen, "moves")
    # moves without an edge count among themselves, which is not looked at
    counted = running(chosen, ["traj_id", "edge_index"], "visit", "taken", "sum", F.lit(1).cast("long"), single=single)
    return counted.withColumn("taken", F.when(F.col("edge_index").isNotNull(), F.col("taken")))


def checks(events: DataFrame, nodes: DataFrame, edges: DataFrame, defs: DataFrame, config: ValidationConfig | None = None, *, single: bool | None = None) -> DataFrame:
    """``traj_id, passed, reason``: every check of every trajectory; ``reason`` is what its failing says.

    The checks of an event, a visit or a move are an array of its row, so each
    table is read once; visits are written once. ``single`` says that every
    trajectory lies within one chunk; None parts them.
    """
    if single is None:
        return in_parts(events, "traj_id", "ord", lambda rows, short: checks(rows, nodes, edges, defs, config, single=short))
    c = config or ValidationConfig()
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    check = lambda ok, reason: F.struct(ok.alias("passed"), reason.alias("reason"))
    rows = lambda df, *found: df.select("traj_id", F.explode(F.array_compact(F.array(*found))).alias("x")).select("traj_id", "x.*")
    seen = visits(known_events(events, nodes, single=single), single=single)
    seen = write_shared(seen, "visits") if single else seen
    moves = transitions(seen, edges, single=single)
    ids = broadcast_if_small(nodes.select(F.col("workflow").alias("w"), F.col("id").alias("i"), "max_visits"))
    # events: trust, and whether the node is known
    node = F.when(F.col("node_id").isNull(), check(F.lit(False), text("missing_node_id:", F.col("event_id"))) if c.require_node_ids else F.lit(None))
    node = node.otherwise(check(F.col("i").isNotNull(), text("unknown_node:", F.col("node_id"))))
    trusted = F.coalesce(F.col("trusted") & F.col("source").isin(*c.trusted_sources), F.lit(False))
    placed = events.select("traj_id", "workflow", "event_id", "node_id", "trusted", "source").join(ids, (F.col("workflow") == F.col("w")) & (F.col("node_id") == F.col("i")), "left")
    out = [rows(placed, *([check(trusted, text("untrusted_event:", F.col("event_id")))] if c.require_trusted else []), node)]
    # trajectories: repeated ids, start and end
    repeats = events.groupBy("traj_id", "event_id").agg(F.count(F.lit(1)).alias("n"), F.max("workflow").alias("workflow")).groupBy("traj_id").agg(F.max("n").alias("n"), F.max("workflow").alias("workflow"))
    ends = seen.groupBy("traj_id").agg(F.min_by("node_id", "visit").alias("first"), F.max_by("node_id", "visit").alias("last"))
    d = broadcast_if_small(defs.select(F.col("name").alias("w"), "start", "terminals"))
    whole = repeats.join(ends, "traj_id", "left").join(d, F.col("workflow") == F.col("w"), "left")
    started = check(F.coalesce(F.col("first") == F.col("start"), F.lit(False)), text("wrong_start:", F.col("first"))) if c.require_start else F.lit(None)
    found = [check(F.col("n") <= 1, F.lit("duplicate_event_id")), F.when(F.col("first").isNull(), check(F.lit(False), F.lit("no_mapped_workflow_path"))).otherwise(started)]
    if c.require_terminal:
        reached = F.coalesce(F.array_contains("terminals", F.col("last")), F.lit(False))
        found.append(check(reached, text("terminal_not_reached:", F.coalesce("last", F.lit("<none>")))))
    out.append(rows(whole, *found))
    # visits: numbers in order, and not too many
    counted = running(seen, ["traj_id", "node_id"], "visit", "nth", "sum", F.lit(1).cast("long"), single=single)
    out.append(rows(counted, check(F.col("occ") == F.col("nth"), text("non_sequential_occurrence:", F.col("node_id"), ":", F.col("occ"), "!=", F.col("nth")))))
    per_node = seen.groupBy("traj_id", "workflow", "node_id").agg(F.count(F.lit(1)).alias("n"))
    limited = per_node.join(ids, (F.col("workflow") == F.col("w")) & (F.col("node_id") == F.col("i")))
    out.append(rows(limited, check(F.col("n") <= F.col("max_visits"), text("node_visit_limit_exceeded:", F.col("node_id"), ":", F.col("n"), ">", F.col("max_visits")))))
    # moves: one kind asked for, an edge that serves, not too often
    wanted = F.when(F.col("kind").isNotNull(), F.concat(F.lit(":"), F.col("kind"))).otherwise("")
    over = text("edge_traversal_limit_exceeded:", F.col("prev_node_id"), "->", F.col("node_id"), ":", F.col("taken"), ">", F.col("max_traversals"))
    legal = F.when(F.col("edge_index").isNull(), check(F.lit(False), text("illegal_transition:", F.col("prev_node_id"), "->", F.col("node_id"), wanted)))
    legal = legal.otherwise(check(F.col("taken") <= F.col("max_traversals"), over))
    out.append(rows(moves, check(F.col("n_kinds") <= 1, text("conflicting_transition_kinds:", F.col("node_id"), "#", F.col("occ"))), legal))
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every


def validity(checked: DataFrame) -> DataFrame:
    """``traj_id, checks_passed, checks_total, validity, valid`` of :func:`checks`."""
    return checked.groupBy("traj_id").agg(
        F.sum(F.col("passed").cast("long")).alias("checks_passed"), F.count(F.lit(1)).alias("checks_total")
    ).withColumn("validity", F.col("checks_passed") / F.col("checks_total")).withColumn("valid", F.col("checks_passed") == F.col("checks_total"))


def violations(checked: DataFrame) -> DataFrame:
    """The different ``reason`` of failed checks of each trajectory."""
    return checked.filter(~F.col("passed")).select("traj_id", "reason").distinct()


def ambiguous(moves: DataFrame) -> DataFrame:
    """``traj_id, visit, warning`` of transitions that several edges serve and none is asked for; ``moves`` is :func:`transitions`."""
    some = moves.filter((F.col("n_edges") > 1) & F.col("kind").isNull())
    return some.select("traj_id", "visit", F.concat(F.lit("ambiguous_transition:"), "prev_node_id", F.lit("->"), "node_id").alias("warning"))


def state_observations(known: DataFrame, raw: DataFrame, *, single: bool = False) -> DataFrame:
    """``traj_id, node_id, occ, before, after``: per visit the first non-empty state before and the last after.

    ``known`` is :func:`known_events` of ``raw``, which holds the states. Of
    several visits with one number the last counts. Visits without states give
    no row.
    """
    numbered = _with_visits(known, single)
    states = raw.select(F.col("traj_id").alias("t"), F.col("ord").alias("o"), "state_before", "state_after")
    numbered = numbered.join(states, (F.col("traj_id") == F.col("t")) & (F.col("ord") == F.col("o")))
    filled = lambda c: F.when(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s", "").isin("", "{}", "null"), F.lit(None)).otherwise(c)
    b, a = filled(F.col("state_before")), filled(F.col("state_after"))
    per = numbered.groupBy("traj_id", "node_id", "occ", "visit").agg(
        F.min_by(b, F.when(b.isNotNull(), F.col("ord"))).alias("before"), F.max_by(a, F.when(a.isNotNull(), F.col("ord"))).alias("after")
    )
    some = per.filter("before is not null or after is not null")
    last = some.groupBy("traj_id", "node_id", "occ").agg(F.max_by(F.struct("before", "after"), "visit").alias("x"))
    return last.select("traj_id", "node_id", "occ", F.coalesce("x.before", F.lit("{}")).alias("before"), F.coalesce("x.after", F.lit("{}")).alias("after"))


def clip(c, limit: int):
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("…"))).otherwise(c)


def rendered(events: DataFrame, *, max_field_chars: int = 2000) -> DataFrame:
    """``traj_id, ord, text``: every event as the scorer reads it; JSON payloads with sorted keys."""
    if max_field_chars <= 0:
        raise ValueError("max_field_chars must be positive")
    cut = lambda name: clip(X.optional(F.col(name)), max_field_chars)
    line = lambda label, value: F.concat(F.lit(label), value)
    head = F.concat(
        F.lit("<trace_event "),
        F.concat_ws(" ", line("id=", cut("event_id")), line("source=", F.col("source")), line("status=", F.col("status")), line("node=", cut("node_id")),
                    line("occurrence=", F.col("occurrence").cast("string")), line("transition=", F.col("transition_kind"))),
        F.lit(">"),
    )
    body = F.concat_ws(
        "\n", head, line("Action: ", cut("action")), line("Tool: ", cut("tool_name")), line("Tool input: ", clip(stable_json(F.col("tool_input")), max_field_chars)),
        line("Evidence: ", cut("evidence")), line("Tool output: ", clip(stable_json(F.col("tool_output")), max_field_chars)), line("Outcome: ", cut("outcome")), F.lit("</trace_event>"),
    )
    return events.select("traj_id", "ord", body.alias("text"))


#: Which node a call and its meaning (``action, evidence, outcome, status``) belong to.
NodeResolver = Callable[[Call, Column], Column]


def adapted(calls: DataFrame, custom: dict[str, Handler] | None = None, *, trusted: bool = False, redact: bool = True, resolver: NodeResolver | None = None) -> DataFrame:
    """Tool calls as events in the columns of an event table, and their ``handler``.

    Source and trust are the adapter's, never the call's. Inputs, outputs and
    metadata lose what their sensitive keys hold unless ``redact`` is off. A
    ``resolver`` replaces the nodes of the calls. States that ``calls`` lacks are null.
    """
    rows, call = Call.parsed(calls)
    named = rows.withColumn("handler", handler_name(call, custom)).withColumn("x", semantics(call, F.col("handler"), custom))
    shown = (lambda c: redact_json(F.col(c))) if redact else F.col
    given = lambda c: F.col(c) if c in calls.columns else F.lit(None).cast("string")
    return named.select(
        "traj_id", "ord", F.col("call_id").alias("event_id"), "x.action", (resolver(call, F.col("x")) if resolver else X.optional(F.col("node_id"))).alias("node_id"), "occurrence",
        "x.evidence", "x.outcome", "x.status", F.lit("runtime").alias("source"), F.lit(trusted).alias("trusted"), F.lower(X.optional(F.col("transition_kind"))).alias("transition_kind"),
        "tool_name", shown("arguments").alias("tool_input"), shown("output").alias("tool_output"), given("state_before").alias("state_before"), given("state_after").alias("state_after"),
        shown("metadata").alias("metadata"), "handler",
    )
