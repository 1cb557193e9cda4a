"""Scores of training rows end to end."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import fields, replace
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from trailmark.functions import text as X
from trailmark.functions.payloads import decoded, resolver
from trailmark.functions.tools import records_events
from trailmark.operators.align import ScorerConfig, score_samples
from trailmark.operators.confidence import RoutingConfig, assess
from trailmark.operators.embed import Cached
from trailmark.operators.events import ValidationConfig
from trailmark.operators.traces import TRACE_REWARD, events_of, render, score_trace
from trailmark.operators.workflow import WorkflowConfig, score_workflow

#: What a row may carry beside its steps, in ``extra_info``.
CARRIED = ["workflow_ground_truth", "trace_events", "tool_calls", "workflow_config", "trace_validation_config", "state_observations", "tool_adapter_config"]
_LIST_PARTS = ("action", "evidence", "outcome")


def workflow_spec(value: dict[str, Any]) -> str:
    """A workflow as a row carries it, in the form that scoring reads: texts as lists, defaults filled in."""
    node = lambda n: {"stage": "default", "required": True, "weight": 1.0, "max_visits": 1, "preconditions": None, "postconditions": None} | n | {
        p: [n[p]] if isinstance(n.get(p), str) else n.get(p) for p in _LIST_PARTS
    }
    edge = lambda e: {"source": e.get("source", e.get("from")), "target": e.get("target", e.get("to")), "kind": e.get("kind", "forward"), "max_traversals": e.get("max_traversals", 1)}
    nodes = [node(n) for n in value["nodes"]]
    ids = {n["id"] for n in nodes}
    spec = {"nodes": nodes, "edges": [edge(e) for e in value.get("edges") or []], "start": value["start"], "terminals": value["terminals"], "stage_weights": value.get("stage_weights") or {}}
    if len(ids) != len(nodes) or spec["start"] not in ids or not spec["terminals"] or not set(spec["terminals"]) <= ids or any(e[s] not in ids for e in spec["edges"] for s in ("source", "target")):
        raise ValueError("a workflow has unknown or repeated nodes")
    return json.dumps(spec)


def _configured(config, given: str | None):
    """A configuration with what a row says of it."""
    own = decoded(given)
    known = {f.name for f in fields(config)}
    if not isinstance(own, dict):
        return config
    return replace(config, **{k: tuple(v) if isinstance(v, list) else v for k, v in own.items() if k in known})


_CARRIED_RESULT = T.StructType([T.StructField("reward", TRACE_REWARD), T.StructField("told", T.StringType())])


def _along_workflows(rows: DataFrame, keep: list[str], scorer: ScorerConfig, config: WorkflowConfig, validation: ValidationConfig) -> DataFrame:
    """``keep`` and ``w``: the reward of rows that carry a workflow, and the text that was scored; null for others."""
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("w", _CARRIED_RESULT)])
    kind, k = to_arrow_type(_CARRIED_RESULT), len(keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = Cached(scorer.encoder, scorer.cache_size).encode
        for batch in batches:
            out = []
            for answer, wf, events, adapted, wc, vc, states, redact in zip(*(batch.column(k + i).to_pylist() for i in range(8)), strict=True):
                value, states = decoded(wf), decoded(states)
                if not isinstance(value, dict) or not (answer or events):
                    out.append(None)
                    continue
                states = states if isinstance(states, dict) else {}
                own, checks = _configured(config, wc), _configured(validation, vc)
                trusted = adapted or isinstance(decoded(vc), dict) and decoded(vc).get("allow_serialized_trust") is True
                trace = events_of(events, redact=bool(adapted and redact), allow_trust=bool(trusted))
                if trace is None:
                    got = score_workflow(encode, workflow_spec(value), answer, states, scorer, own) | {"trace": None}
                else:
                    got = score_trace(encode, workflow_spec(value), trace, states, scorer, own, checks)
                out.append({"reward": {n: got[n] for n in TRACE_REWARD.names}, "told": answer if trace is None else render(trace, checks.max_field_chars)})
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(k)), pa.array(out, kind)], names=schema.names)

    carried = ["answer", "workflow_ground_truth", "__events", "__adapted", "workflow_config", "trace_validation_config", "state_observations", "__redact"]
    return rows.select(*keep, *carried).mapInArrow(run, schema)


def _result(w: Column) -> Column:
    """What routing reads of a reward along a workflow."""
    r = w["reward"]
    return F.struct(
        r["score"].alias("score"), r["contract_match_rate"].alias("match_rate"), r["contract_order_rate"].alias("order_rate"), r["matched_steps"].alias("matched_steps"),
        r["unmatched_steps"].alias("unmatched_steps"), r["mean_matched_sim"].alias("mean_matched_sim"), r["mean_margin"].alias("mean_margin"), F.lit(False).alias("trace_denied"),
    )


def compute_scores(rows: DataFrame, *, key: str = "row_id", scorer: ScorerConfig | None = None, routing: RoutingConfig | None = None, encoder: bool = True,
                   step_paths: tuple[str, ...] | str = (), workflow: WorkflowConfig | None = None, validation: ValidationConfig | None = None) -> DataFrame:
    """Score rows with ``ground_truth, extra_info, solution_str``.

    Thinking is split off, steps are resolved, the answer is aligned with them,
    repetition is penalised and the score routed. A row whose ``extra_info`` (or
    ground truth) has a ``workflow_ground_truth`` is scored along it instead, by
    its ``trace_events`` if it has some, else by its ``tool_calls`` as events,
    else by its answer; ``workflow_config``, ``trace_validation_config``,
    ``state_observations`` and ``tool_adapter_config`` hold for that row.
    Without an encoder steps are looked up word for word. ``step_paths`` are
    dotted paths, or one text with commas between them.

    Columns: ``key, score, semantic_score, match_rate, order_rate,
    matched_steps, unmatched_steps, step_tiers, steps_source, n_steps,
    think_len, repetition_rate, penalty, confidence, fallback, reasons,
    workflow`` (a struct with the best path, candidates, states and the trace;
    null without a workflow). A null solution is empty; rows without steps or
    answer score 0 and are routed to a judge.
    """
    scorer = scorer or ScorerConfig()
    if isinstance(step_paths, str):
        step_paths = tuple(p.strip() for p in step_paths.split(",") if p.strip())
    inside = lambda name: F.get_json_object("extra_info", f"$.{name}").alias(name)
    split = rows.select(key, X.split_think(F.col("solution_str")).alias("t"), resolver(step_paths)(F.col("extra_info"), F.col("ground_truth")).alias("r"),
                        F.get_json_object("ground_truth", "$.workflow_ground_truth").alias("__truth"), *[inside(n) for n in CARRIED])
    split = split.withColumn("workflow_ground_truth", F.coalesce("workflow_ground_truth", "__truth"))
    adapter = lambda name: F.get_json_object("tool_adapter_config", f"$.{name}")
    trusted = F.coalesce(adapter("trusted_runtime") == "true", F.lit(False))
    adapted = F.to_json(records_events(F.col("tool_calls"), trusted))
    split = split.withColumns({
        "__events": F.coalesce("trace_events", adapted), "__adapted": F.col("trace_events").isNull() & F.col("tool_calls").isNotNull(),
        "__redact": F.coalesce(adapter("redact_sensitive") != "false", F.lit(True)), "answer": F.col("t.answer"),
    })
    has = F.col("workflow_ground_truth").isNotNull() & ((F.col("t.answer") != "") | F.col("__events").isNotNull())
    some = ["think", "answer", "steps", "source"]
    ready = split.select(key, "t.think", "answer", F.col("r.steps").alias("steps"), F.col("r.source").alias("source"), has.alias("has"),
                         *[c for c in split.columns if c.startswith("__") and c != "__truth"], *[c for c in CARRIED if c not in ("trace_events", "tool_calls")])
    both = (F.size("steps") > 0) & (F.col("answer") != "")
    if encoder:
        along = _along_workflows(ready, [key, *some, "has"], scorer, workflow or WorkflowConfig(), validation or ValidationConfig())
        given = F.when(F.col("has"), F.array().cast("array<array<string>>")).otherwise(F.col("steps"))
        scored = score_samples(along, [key, *some, "w"], F.col("answer"), given, scorer)
        walked = F.col("w").isNotNull()
        linear = F.struct(*[F.col("result")[n].alias(n) for n in ("score", "match_rate", "order_rate", "matched_steps", "unmatched_steps", "mean_matched_sim", "mean_margin", "trace_denied")])
        scored = scored.withColumn("x", F.when(walked, _result(F.col("w"))).otherwise(linear)).withColumn("asked", F.when(walked, F.col("w.reward.required_steps")).otherwise(F.col("steps")))
        scored = assess(scored.withColumn("told", F.coalesce("w.told", "answer")), "x", "told", "asked", "j", routing)
        of = lambda name, plain: F.when(walked, F.col(f"w.reward.{name}")).otherwise(F.col(f"x.{plain}"))
        semantic, match, order = of("score", "score"), of("required_coverage", "match_rate"), of("order_rate", "order_rate")
        also = F.array_compact(F.array(
            F.when(F.col("w.reward.state_gate_passed") == F.lit(False), "workflow_state_gate_failed"), F.when(F.col("w.reward.truncated"), "workflow_paths_truncated"),
            F.when(F.col("w.reward.trace.valid") == F.lit(False), "workflow_trace_invalid"),
        ))
        reasons, told = F.concat("j.reasons", also), both | walked
        fallback = F.size(reasons) > 0
    else:
        share = X.label_share(F.col("answer"), F.col("steps"))
        scored = ready.withColumn("share", share).withColumn("w", F.lit(None).cast(_CARRIED_RESULT))
        semantic = match = order = F.col("share")
        judged = F.struct(F.lit(0.0).alias("confidence"), F.lit(True).alias("fallback"), F.array(F.lit("no_embedding_backend")).alias("reasons"))
        missing = F.transform("steps", X.step_label)
        scored = scored.withColumn("j", judged).withColumn("x", F.struct(F.array().cast("array<string>").alias("matched_steps"), missing.alias("unmatched_steps"))).withColumn("asked", F.col("steps"))
        reasons, fallback, told = F.col("j.reasons"), F.lit(True), both | (F.col("has") & (F.col("answer") != ""))
    repeated = scored.withColumn("pieces", X.long_pieces(F.col("answer"))).withColumn("rep", X.repetition(F.col("pieces")))
    empty = F.transform("steps", X.step_label)
    r = F.col("w.reward")
    detail = F.struct(
        r["best_path"].alias("best_path"), r["candidate_paths"].alias("candidate_paths"), r["truncated"].alias("paths_truncated"), r["state_score"].alias("state_score"),
        r["state_gate_passed"].alias("state_gate_passed"), r["optional_coverage"].alias("optional_coverage"), r["node_scores"].alias("node_scores"), r["stages"].alias("stages"), r["trace"].alias("trace"),
    )
    return repeated.select(
        key, F.greatest(semantic + F.col("rep.penalty"), F.lit(0.0)).alias("score"), semantic.alias("semantic_score"), match.alias("match_rate"), order.alias("order_rate"),
        F.col("x.matched_steps").alias("matched_steps"), F.when(told, F.col("x.unmatched_steps")).otherwise(empty).alias("unmatched_steps"),
        F.transform("asked", X.candidates_tier).alias("step_tiers"),
        F.col("source").alias("steps_source"), F.size("steps").alias("n_steps"), F.length("think").alias("think_len"), F.col("rep.rate").alias("repetition_rate"),
        F.col("rep.penalty").alias("penalty"), F.when(told, F.col("j.confidence")).otherwise(0.0).alias("confidence"), F.when(told, fallback).otherwise(True).alias("fallback"),
        F.when(told, reasons).otherwise(F.array(F.lit("missing_steps_or_response"))).alias("reasons"), F.when(F.col("w").isNotNull(), detail).alias("workflow"),
    )
