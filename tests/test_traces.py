"""Traces, training rows, adapters, models, readers and streams on small inputs."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from trailmark import queries as Q
from trailmark.api import compute_scores, workflow_spec
from trailmark.functions import payloads
from trailmark.operators import align, batches, embed, events, experiments, quality, traces
from trailmark.operators import workflow as W
from trailmark.operators.align import ScorerConfig
from trailmark.operators.embed import Cached, ConceptEncoder
from trailmark.sources import readers
from trailmark.streaming import traces as streams

NODES = [{"id": "first", "action": "look", "postconditions": {"seen": True}}, {"id": "second", "action": ["mend", "repair"]}, {"id": "other", "action": "swap"}, {"id": "last", "action": "close"}]
EDGES = [{"from": "first", "to": "second"}, {"source": "first", "target": "other", "kind": "alternative"}, {"source": "second", "target": "last"}, {"source": "other", "target": "last"}]
FLOW = {"nodes": NODES, "edges": EDGES, "start": "first", "terminals": ["last"]}
WORDS = "look at it, then a pause without any news, mend it, later some rest of another kind, close it."
SPEC = workflow_spec(FLOW)
SCORER = ScorerConfig(threshold=0.45, coarse=(64, 32), fine=(32, 16), encoder=ConceptEncoder({w: [w] for w in ("look", "mend", "swap", "close")}))


def event(i, node, action, **kw):
    return {"event_id": f"e{i}", "node_id": node, "action": action, "source": "runtime", "trusted": True} | kw


GOOD = [event(0, "first", "look", state_after={"seen": True}), event(1, "second", "mend"), event(2, "last", "close")]


def scored(raw, config=None, **validation):
    return traces.score_trace(Cached(SCORER.encoder).encode, SPEC, traces.parsed(raw), None, SCORER, config or W.WorkflowConfig(), events.ValidationConfig(**validation))


def test_a_clean_trace():
    got = scored(GOOD)
    t = got["trace"]
    assert t["valid"] and t["terminal_reached"] and t["node_path"] == ["first", "second", "last"] and t["edge_kinds"] == ["forward", "forward"]
    # ids, trust 3, nodes 3, start, occurrences 3, visits 3, kinds 2, edges 2, end
    assert (t["checks_passed"], t["checks_total"]) == (19, 19) and got["score"] == pytest.approx(1.0) and got["state_score"] == 1.0


def test_gates_and_reasons():
    bad = [GOOD[0], GOOD[1] | {"trusted": False}, event(1, "last", "close"), event(3, "gone", "close"), event(4, None, "close")]
    t = scored(bad)["trace"]
    assert t["violations"] == ["duplicate_event_id", "untrusted_event:e1", "unknown_node:gone", "missing_node_id:e4"]
    assert scored(bad)["score"] == 0
    soft = scored(bad, W.WorkflowConfig(hard_trace_gate=False))
    assert soft["score"] == pytest.approx(soft["semantic_score"] * (0.75 + 0.25 * t["validity"]))
    assert scored(bad[:1] + GOOD[1:], require_trusted=False)["trace"]["valid"]
    # the nodes say another way than the text
    told = scored([GOOD[0], event(1, "other", "mend"), GOOD[2]])
    assert told["trace"]["violations"] == ["semantic_path_mismatch:first->other->last!=first->second->last"] and told["trace"]["checks_total"] == 20
    assert scored([event(0, "second", "mend")])["trace"]["violations"][:2] == ["wrong_start:second", "terminal_not_reached:second"]
    assert scored([event(0, None, "mend")], require_node_ids=False)["trace"]["violations"] == ["no_mapped_workflow_path", "terminal_not_reached:<none>"]


def test_given_states_go_first():
    seen = {"first#1": {"after": {"seen": False}}}
    got = traces.score_trace(Cached(SCORER.encoder).encode, SPEC, traces.parsed(GOOD), seen, SCORER, W.WorkflowConfig(), events.ValidationConfig())
    assert got["state_gate_passed"] is False and got["state_score"] == 0 and got["score"] == pytest.approx(0.75)


def test_ambiguous_edges_warn():
    two = workflow_spec(FLOW | {"edges": [*EDGES, {"source": "first", "target": "second", "kind": "alternative"}]})
    w = traces.walk(traces.parsed(GOOD), W.machine(two), events.ValidationConfig())
    assert w.warnings == ["ambiguous_transition:first->second"] and not w.violations
    asked = [GOOD[0], GOOD[1] | {"transition_kind": " Alternative "}, GOOD[2]]
    assert traces.walk(traces.parsed(asked), W.machine(two), events.ValidationConfig()).edges[0]["kind"] == "alternative"


@pytest.mark.parametrize("change", [{"action": " "}, {"occurrence": 0}, {"status": "odd"}, {"source": "rumour"}])
def test_events_that_break_the_schema(change):
    with pytest.raises(ValueError):
        traces.parsed([GOOD[0] | change])
    with pytest.raises(ValueError):
        events.ValidationConfig(trusted_sources=("rumour",))


def table(spark, raw):
    rows = [{"traj_id": t, "ord": o, "workflow": "w", **{f: e.get(f) for f in traces.FIELDS}} for t, o, e in raw]
    for r in rows:
        r |= {f: json.dumps(r[f]) if isinstance(r[f], dict) else r[f] for f in ("tool_input", "tool_output", "state_before", "state_after", "metadata")}
        r |= {"status": r["status"] or "success", "trusted": bool(r["trusted"])}
    kinds = {"ord": "int", "occurrence": "int", "trusted": "boolean"}
    columns = ["traj_id", "ord", "workflow", *traces.FIELDS]
    return spark.createDataFrame([tuple(r[c] for c in columns) for r in rows], ", ".join(f"{c} {kinds.get(c, 'string')}" for c in columns))


def test_rendering_and_checks_agree_with_the_tables(spark):
    odd = [event(0, "first", "look", tool_input={"b": 1, "a": "é"}, tool_output="plain", tool_name="sh", evidence="x" * 30), event(1, "second", "mend", occurrence=3, outcome="ok"),
           event(2, "second", "mend", transition_kind="retry"), event(3, "first", "look", trusted=False), event(4, "zz", "close"), event(5, None, "close")]
    ev = table(spark, [("a", i, e) for i, e in enumerate(odd)] + [("b", i, e) for i, e in enumerate(GOOD)])
    text = {(r.traj_id, r.ord): r.text for r in events.rendered(ev, max_field_chars=20).collect()}
    for t, raw in (("a", odd), ("b", GOOD)):
        for i, e in enumerate(raw):
            assert traces.render(traces.parsed([e]), 20) == text[t, i]
    m = W.machine(SPEC)
    nodes = spark.createDataFrame([("w", n["id"], n["max_visits"]) for n in m.nodes.values()], "workflow string, id string, max_visits int")
    edges = spark.createDataFrame([("w", k, e["source"], e["target"], e["kind"], e["max_traversals"]) for k, e in enumerate(m.edges)],
                                  "workflow string, edge_index int, source string, target string, kind string, max_traversals int")
    defs = spark.createDataFrame([("w", "first", ["last"])], "name string, start string, terminals array<string>")
    checked = events.checks(ev, nodes, edges, defs)
    reasons = {t: set() for t in "ab"}
    for r in events.violations(checked).collect():
        reasons[r.traj_id].add(r.reason)
    validity = {r.traj_id: (r.checks_passed, r.checks_total) for r in events.validity(checked).collect()}
    for t, raw in (("a", odd), ("b", GOOD)):
        w = traces.walk(traces.parsed(raw), m, events.ValidationConfig())
        assert set(w.violations) == reasons[t] and (sum(ok for ok, _ in w.checks), len(w.checks)) == validity[t]


def test_attempts_and_their_scores(spark):
    twice = [(*x, e) for x, e in zip([("t", i) for i in range(9)], [*GOOD, event(3, None, "rest"), *(GOOD[i % 3] | {"event_id": f"f{i}"} for i in range(5))], strict=True)]
    ev = table(spark, [(t, i * 10, e) for t, i, e in twice])
    defs = spark.createDataFrame([("w", "first")], "name string, start string")
    nodes = spark.createDataFrame([("w", n["id"]) for n in NODES], "workflow string, id string")
    known = events.known_events(ev, nodes)
    at = {r.ord: (r.attempt, r.part) for r in traces.attempts(ev, known, defs, max_events=2).collect()}
    assert at == {0: (1, 0), 10: (1, 0), 20: (1, 1), 30: (1, 1), 40: (2, 0), 50: (2, 0), 60: (2, 1), 70: (3, 0), 80: (3, 0)}
    specs = spark.createDataFrame([("w", SPEC)], "workflow string, spec string")
    whole = traces.collected_events(ev, traces.attempts(ev, known, defs))
    got = {r.attempt: r.reward for r in traces.score_traces(whole, ["attempt"], specs, scorer=SCORER).collect()}
    assert [got[k].trace.valid for k in (1, 2, 3)] == [False, True, False] and got[2].score == pytest.approx(1.0) and got[1].score == 0
    assert got[1].trace.violations == ["missing_node_id:e3"] and got[3].trace.violations == ["terminal_not_reached:second"]
    rows = sorted(traces.event_potentials(whole.filter("attempt = 2"), ["attempt"], specs, scorer=SCORER, gamma=0.5).collect(), key=lambda r: r.ord)
    assert [r.potential for r in rows] == pytest.approx([1 / 3, 2 / 3, 1.0]) and [r.shaped_reward for r in rows] == pytest.approx([1 / 6, 0.0, -1 / 6]) and all(r.valid for r in rows)
    assert traces.score_traces(whole.limit(0), ["attempt"], specs, scorer=SCORER).count() == 0
    assert "null" in whole.limit(1).select(traces.to_json(F.struct(F.lit(None).cast("int").alias("x"))).alias("j")).first().j


CALLS = [{"id": "c0", "name": "read_file", "input": {"path": "a.py", "api_key": "k"}, "result": "text", "node_id": "first", "state_after": {"seen": True}},
         {"tool": "bash", "arguments": "mend it", "output": {"returncode": 1}, "result": {"returncode": 0}, "node_id": "second"}]


def test_training_rows_along_workflows(spark):
    extra = [
        {"workflow_ground_truth": FLOW}, {"workflow_ground_truth": FLOW, "trace_events": GOOD, "trace_validation_config": {"allow_serialized_trust": True}},
        {"workflow_ground_truth": FLOW, "trace_events": GOOD}, {"workflow_ground_truth": FLOW, "tool_calls": CALLS, "tool_adapter_config": {"trusted_runtime": True}},
        {"reference_steps": ["look", "mend"]}, None, {"workflow_ground_truth": FLOW, "trace_events": GOOD, "workflow_config": {"hard_trace_gate": False}},
    ]
    rows = [(i, None, e and json.dumps(e), f"<think>x</think>{WORDS}" if i != 5 else None) for i, e in enumerate(extra)]
    df = spark.createDataFrame(rows, "row_id int, ground_truth string, extra_info string, solution_str string")
    got = {r.row_id: r for r in compute_scores(df, scorer=SCORER).collect()}
    assert got[0].score == pytest.approx(1.0) and got[0].workflow.best_path == ["first", "second", "last"] and got[0].workflow.trace is None
    assert got[1].workflow.trace.valid and got[1].score == pytest.approx(1.0)
    # a row can't make its own events trusted
    assert got[2].score == 0 and "workflow_trace_invalid" in got[2].reasons and got[2].fallback and "untrusted_event:e0" in got[2].workflow.trace.violations
    assert got[6].score > 0
    t = got[3].workflow.trace
    assert t.node_path == ["first", "second"] and t.trusted_events == 2 and t.violations == ["terminal_not_reached:second"]
    assert got[4].workflow is None and got[4].match_rate == 1 and got[4].matched_steps == ["look", "mend"] and got[4].step_tiers == ["reasoning"] * 2
    assert got[5].reasons == ["missing_steps_or_response"] and got[5].score == 0
    plain = {r.row_id: r for r in compute_scores(df, encoder=False).collect()}
    assert plain[4].score == 1 and plain[4].reasons == ["no_embedding_backend"] and plain[0].reasons == ["no_embedding_backend"]
    assert compute_scores(df.limit(0), scorer=SCORER).count() == 0
    own = spark.createDataFrame([(1, None, '{"a": {"b": ["look"]}}', "look")], df.schema)
    assert compute_scores(own, scorer=SCORER, step_paths="z, a.b").first().steps_source == "extra_info.a.b"


def test_adapter_keeps_payloads(spark, tmp_path):
    p = tmp_path / "c.jsonl"
    p.write_text(json.dumps({"traj_id": "t", "tool_calls": CALLS}) + "\n")
    calls = readers.read_tool_calls(spark, str(p))
    a, b = calls.orderBy("ord").collect()
    assert (a.call_id, a.tool_name, a.output, json.loads(a.arguments)["path"]) == ("c0", "read_file", "text", "a.py")
    assert (b.call_id, b.tool_name, b.arguments, b.exit_code) == ("tool-call-1", "bash", "mend it", 1)
    x, y = events.adapted(calls, trusted=True).orderBy("ord").collect()
    assert json.loads(x.tool_input) == {"path": "a.py", "api_key": payloads.MASK} and x.state_after == '{"seen":true}' and x.source == "runtime" and x.trusted
    assert (y.status, y.evidence) == ("failure", "command: mend it; exit code: 1")
    assert json.loads(events.adapted(calls, redact=False).orderBy("ord").first().tool_input)["api_key"] == "k"
    named = events.adapted(calls, resolver=lambda call, x: F.concat(F.lit("n-"), x["status"]))
    assert [r.node_id for r in named.orderBy("ord").collect()] == ["n-success", "n-failure"]
    p.write_text('{"traj_id": "t", "tool_calls": [{"input": 1}]}\n')
    with pytest.raises(Exception, match="no name"):
        readers.read_tool_calls(spark, str(p)).collect()
    df = spark.createDataFrame([('{"a": {"b": 1, "c": 2}}', '{"a": {"b": 1}}'), ('{"a": 1}', '{"a": 2}'), (None, None)], "x string, y string")
    assert [r.z for r in df.select(payloads.json_contains("x", "y").alias("z")).collect()] == [True, False, True]
    assert df.select(payloads.redact_json(F.lit('{"a":  1}')).alias("z")).first().z == '{"a":  1}'


def test_models_by_role_and_batch():
    asked = []

    def loader(spec):
        def forward(texts):
            asked.append(list(texts))
            return np.array([[[float(len(t)), 1.0], [0.0, 3.0]] for t in texts], dtype=np.float32), np.array([[1, 0]] * len(texts))

        return forward

    spec = embed.ModelSpec.of("models/multilingual-e5-small/", batch=2)
    assert (spec.pooling, spec.query, spec.passage) == ("mean", "query: ", "passage: ") and embed.ModelSpec.of("x").pooling == "cls"
    assert embed.ModelSpec.of("intfloat/multilingual-e5-base", pooling="cls").pooling == "cls"
    encoder = embed.load_encoder("models/multilingual-e5-small/", loader=loader, batch=2)
    c = Cached(encoder)
    v = c.encode(["ab", "ab", "ab", "c"], ["query", "passage", "query", "passage"])
    assert asked == [["query: ab", "passage: ab"], ["passage: c"]] and (v[0] == v[2]).all() and not (v[0] == v[1]).all()
    assert np.allclose(np.linalg.norm(v, axis=1), 1) and c.stats() == {"size": 3, "max_size": 8192, "hits": 1, "misses": 3, "hit_rate": 0.25}
    assert embed.load_encoder("no/such/folder") is None
    assert embed.provider(["CPUExecutionProvider", "CUDAExecutionProvider"]) == ("CUDAExecutionProvider", "float16") and embed.provider([])[0] == "CPUExecutionProvider"
    with pytest.raises(ValueError):
        embed.ModelEncoder(embed.ModelSpec("x", pooling="max"))


def test_batches_are_encoded_at_once():
    from trailmark.operators.align import score_response, warmed

    seen = []

    class Counting(ConceptEncoder):
        def encode(self, texts):
            seen.append(len(texts))
            return super().encode(texts)

    config = ScorerConfig(threshold=0.45, encoder=Counting({"look": ["look"], "mend": ["mend"]}))
    rows, steps = [WORDS, WORDS * 3, ""], [[["look"], ["mend"]], [["mend"]], [["look"]]]
    encode = warmed(config, rows, steps, [False, False, True])
    got = [score_response(encode, r, s, config) for r, s in zip(rows, steps, strict=True)]
    assert len(seen) == 1 and [g["score"] for g in got] == [score_response(Cached(config.encoder).encode, r, s, config)["score"] for r, s in zip(rows, steps, strict=True)]
    assert set(experiments.stage_timings(rounds=1)) == {"ms_windows", "ms_encode_cold", "ms_encode_warm", "ms_product", "ms_path", "ms_graph", "ms_enumerate"}


def test_vectors_are_looked_up_by_role_and_text(spark):
    users = spark.createDataFrame([(1, "query", "look"), (2, "query", "look"), (3, "passage", "look"), (4, "query", None), (5, "query", "")], "u int, role string, text string")
    got = {r.u: r.embedding for r in embed.looked_up(users, embed.encode_texts(users, SCORER.encoder)).collect()}
    assert got[1] == got[2] == got[3] == [1, 0, 0, 0] and got[4] is None and got[5] == [0, 0, 0, 0]
    assert sorted(tuple(r) for r in embed.cache_stats(users).collect()) == [("passage", 1, 1, 0.0), ("query", 3, 2, pytest.approx(1 / 3))]
    assert embed.cache_stats(users.limit(0)).count() == 0


def test_intermediate_tables_are_deleted(spark):
    import os

    from trailmark.plans.shared import intermediate, write_shared

    with intermediate():
        path = write_shared(spark.range(3), "x").inputFiles()[0]
        folder = os.path.dirname(path.removeprefix("file:").replace("///", "/"))
        assert os.path.isdir(folder)
    assert not os.path.isdir(folder)


def test_settings_of_the_environment(monkeypatch):
    monkeypatch.setenv("OLD_THRESHOLD", "0.2")
    monkeypatch.setenv("OLD_MAX_WINDOWS", "9")
    monkeypatch.setenv("TRAILMARK_THRESHOLD", "0.3")
    monkeypatch.setenv("TRAILMARK_MODEL", "no/such/folder")
    got = ScorerConfig.from_env(legacy=("OLD_",))
    assert (got.threshold, got.max_windows, got.encoder.name) == (0.3, 9, "concepts")


def test_own_evidence_patterns(spark):
    df = spark.createDataFrame([("a", "okay 7", [["look"]]), ("b", "look at it", [["look"]])], "id string, r string, s array<array<string>>")
    from trailmark.operators.align import score_samples

    config = ScorerConfig(threshold=0.45, require_trace=True, tool_patterns=("okay",), reasoning_patterns=(), encoder=SCORER.encoder)
    assert {r.id: r.result.trace_denied for r in score_samples(df, ["id"], F.col("r"), F.col("s"), config).collect()} == {"a": False, "b": True}


def test_layers_and_report(spark):
    spec, text = experiments.layered_workflow(2, 3)
    m = W.machine(json.dumps(spec))
    assert len(W.enumerate_paths(m, W.WorkflowConfig())[0]) == 8 and len(W.unroll(m, W.WorkflowConfig()).node) == 8 and text.startswith("read the report.")
    with pytest.raises(ValueError):
        experiments.layered_workflow(1, 2)
    cols = "score double, trusted_score double, lexical_score double, confidence double, fallback boolean, trace_denied boolean, label int, subtype string, pair_id string"
    df = spark.createDataFrame([(0.9, 0.9, 0.1, 0.8, False, False, 1, "x", "g"), (0.2, 0.0, 0.3, 0.4, True, True, 0, None, "g"), (0.5, 0.5, 0.5, 0.5, False, False, None, "x", None)], cols)
    got = [(r.block, r.metric, r.value) for r in quality.report(df).collect()]
    assert got == sorted(got, key=lambda r: r[:2])
    value = {r[:2]: r[2] for r in got}
    assert value["dataset", "count"] == 3 and value["semantic", "auroc"] == 1 and value["lexical", "auroc"] == 0 and value["routing", "negative_trace_denial_rate"] == 1
    assert value["subtype:x", "count"] == 2 and value["routed_pairwise", "accuracy"] == 1
    assert {r.metric: r.value for r in quality.report(df.limit(0)).filter("block = 'dataset'").collect()}["count"] == 0
    near = spark.createDataFrame([(0.5, 1), (0.5 + 1e-12, 0), (2e10, 1)], "score double, label int")
    assert quality.ranking(near).first().auroc == 0.5


def test_suites_workflows_and_samples(spark, tmp_path):
    (tmp_path / "w.json").write_text(json.dumps({"name": "w", **FLOW}))
    nodes, edges, defs = readers.read_workflows(spark, str(tmp_path / "w.json"))
    assert nodes.orderBy("node_index").first().action == ["look"] and edges.orderBy("edge_index").first().source == "first" and defs.first().terminals == ["last"]
    assert W.schema_problems(nodes, edges, defs).count() == 0
    (tmp_path / "s.json").write_text(json.dumps({"domains": [{"name": d, "max_turns": 3} for d in "abc"], "ablations": [{"name": "x"}]}))
    assert experiments.run_matrix(*readers.read_suite(spark, str(tmp_path / "s.json"))).count() == 9
    p = tmp_path / "d.jsonl"
    p.write_text('{"id": "a", "response": "r", "reference_steps": ["x"], "label": "odd"}\n{"id": "b", "reference_steps": ["x"]}\n')
    assert readers.read_samples(spark, str(p), strict=False).first().label is None and readers.skipped(spark, str(p)).first() == (2, 1)
    with pytest.raises(Exception, match="unsupported label"):
        readers.read_samples(spark, str(p)).collect()
    own = readers.read_samples(spark, str(p), strict=False)
    both = readers.append_samples(own, own.drop("pair_id").withColumn("subtype", F.lit(None).cast("string")))
    assert [r.subtype for r in both.collect()] == ["unspecified", "external"]


def test_sessions(spark, tmp_path):
    at = dt.datetime(2025, 1, 1)
    rows = [("t", at + dt.timedelta(minutes=m)) for m in (0, 5, 9, 40)] + [("u", at)]
    spark.createDataFrame(rows, "traj_id string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("traj_id string, ts timestamp").parquet(str(tmp_path / "in")).withColumn("at", F.col("ts"))
    got = streams.drained(spark, streams.sessions(stream), "sessions")
    assert sorted((r.traj_id, r.n) for r in got.collect()) == [("t", 1), ("t", 3), ("u", 1)]


def test_traces_scored_together_fare_as_each_alone(spark, sf, monkeypatch):
    """Windows, paths, alignment, states and gates of whole batches against those of one trace, on short and long attempts, with and without a cap."""
    found = W.similarities

    def double(encode, steps, texts):  # equal similarities are equal whatever the shape of the product
        return tuple([x.astype(np.float32) for x in y] if isinstance(y, list) else y.astype(np.float32) for y in found(lambda *a: encode(*a).astype(np.float64), steps, texts))

    monkeypatch.setattr(W, "similarities", double)
    monkeypatch.setattr(align, "similarities", double)
    monkeypatch.setattr(batches, "LONG", 5_000)
    monkeypatch.setattr(batches, "CELLS", 300)
    monkeypatch.setattr(batches, "KEPT", 2_000)
    rows = Q._attempts(spark, sf).join(Q._specs(spark, sf), "workflow").select("spec", F.col("trace").alias("e")).orderBy("e").limit(60).collect()
    rows = [(r.spec, r.e) for r in rows] + [(rows[0].spec, json.dumps([{**json.loads(rows[0].e)[0], "event_id": f"x{i}", "evidence": "Größe · ΑΣ run tests " + "x" * i} for i in range(90)]))]
    for scorer in (Q.ATTEMPT_SCORER, ScorerConfig(threshold=0.6, max_windows=9, encoder=embed.NgramEncoder()), ScorerConfig(threshold=0.45), ScorerConfig(threshold=0.5, coarse_to_fine=False, encoder=embed.NgramEncoder())):
        for config in (W.WorkflowConfig(hard_trace_gate=False), W.WorkflowConfig(require_states=True, hard_state_gate=True)):
            got = traces.score_together(batches.Batch(scorer, config), *map(list, zip(*rows, strict=True)), events.ValidationConfig())
            for (spec, e), one in zip(rows, got, strict=True):
                alone = traces.score_trace(Cached(scorer.encoder).encode, spec, traces.parsed(json.loads(e)), None, scorer, config, events.ValidationConfig())
                assert one == {n: alone[n] for n in one}


def test_batches_score_only_what_they_hold(spark, sf):
    with pytest.raises(ValueError, match="fields are some of"):
        traces.score_traces(Q._attempts(spark, sf), ["attempt"], Q._specs(spark, sf), fields=["mean_margin"])


def test_attempts_cut_in_one_shuffle_are_those_of_prefix_computations(spark, sf):
    """Redelivered rows, ties, blank nodes and workflows that nobody or several name."""
    raw = spark.read.parquet(f"{sf}/trace_events.parquet")
    late = raw.filter("ord % 7 = 0").withColumns({"evidence": F.lit("later"), "ingested_at": F.col("ingested_at") + F.expr("interval 1 day")})
    tied = raw.filter("ord % 5 = 0").withColumn("evidence", F.lit("tied"))
    rest = raw.filter("ord % 11 = 0").withColumns({"traj_id": F.concat("traj_id", F.lit("x")), "node_id": F.lit("  "), "metadata": F.lit('{"workflow": "none"}')})
    raw = raw.withColumn("metadata", F.when(F.col("ord") % 3 == 0, F.lit('{"workflow": "web_booking"}')).otherwise(F.col("metadata"))).unionByName(late).unionByName(tied).unionByName(rest)
    nodes, defs = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("workflow_nodes", "workflow_defs"))
    now = events.current_events(raw)
    for most in (3, traces.MAX_EVENTS):
        want = traces.collected_events(now, traces.attempts(now, events.known_events(now, nodes, single=True), defs, max_events=most, single=True))
        want = want.withColumn("trace", F.to_json(F.transform("trace", lambda e: e.dropFields("metadata"))))
        got = traces.cut_events(raw, nodes, defs, max_events=most)
        assert got.count() == want.count() > 100 and got.exceptAll(want.select(got.columns)).count() == 0
