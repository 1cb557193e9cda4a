"""Operators on tables: sequences, events, tools, texts, quality; with nulls, ties and empty tables."""

import datetime as dt
import hashlib
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from trailmark import queries as Q
from trailmark.functions import payloads, tools
from trailmark.functions import text as X
from trailmark.operators import events, experiments, quality
from trailmark.operators.sequences import by_length, running, with_previous
from trailmark.plans.delivery import latest_delivery
from trailmark.plans.sizing import broadcast_if_small
from trailmark.sources import readers


def test_latest_delivery(spark):
    rows = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "y"), (None, 1, "n"), ("b", None, "z")], "id string, t int, v string")
    for few in (0, 10):
        got = latest_delivery(rows, ["id"], "t", few=few).collect()
        assert len(got) == 3 and {(r.id, r.v) for r in got} == {("a", "y"), (None, "n"), ("b", "z")}
    twice = rows.unionByName(rows).unionByName(spark.createDataFrame([(None, 0, "o"), ("b", None, "q")], rows.schema))
    assert {r.id for r in latest_delivery(twice, ["id"], "t").collect()} == {"a", "b", None} and latest_delivery(twice, ["id"], "t").count() == 3
    assert sorted(map(str, latest_delivery(twice, ["id"], "t").collect())) == sorted(map(str, latest_delivery(twice, ["id"], "t", few=0).collect()))
    assert latest_delivery(rows.limit(0), ["id"], "t").count() == 0
    assert broadcast_if_small(rows).count() == 5 and broadcast_if_small(rows, 2).count() == 5


@pytest.mark.parametrize("chunk", [1, 3, 100])
def test_prefixes_across_chunks(spark, chunk):
    rng = random.Random(chunk)
    data = [(s, o, rng.randint(-5, 5)) for s in "ab" for o in range(20) if rng.random() < 0.8]
    df = spark.createDataFrame(data, "s string, o int, v int")
    sums = {(r.s, r.o): r.x for r in running(df, ["s"], "o", "x", "sum", F.col("v"), chunk=chunk).collect()}
    tops = {(r.s, r.o): r.x for r in running(df, ["s"], "o", "x", "max", F.col("v"), chunk=chunk).collect()}
    prev = {(r.s, r.o): r.prev_v for r in with_previous(df, "s", "o", ["v"], chunk=chunk).collect()}
    for s in "ab":
        own = [(o, v) for t, o, v in data if t == s]
        for i, (o, _) in enumerate(own):
            assert sums[s, o] == sum(v for _, v in own[: i + 1])
            assert tops[s, o] == max(v for _, v in own[: i + 1])
            assert prev[s, o] == (own[i - 1][1] if i else None)


def occurrences(seq):
    """Brute force: explicit numbers win, a repeated node continues, else the node's largest plus one."""
    out, top, before = [], {}, None
    for n, given in seq:
        occ = given if given is not None else before[1] if before and before[0] == n else top.get(n, 0) + 1
        top[n] = max(top.get(n, 0), occ)
        before = (n, occ)
        out.append(occ)
    return out


def test_occurrences_against_brute_force(spark):
    rng = random.Random(5)
    rows, want = [], {}
    for t in range(12):
        seq = [(rng.choice("xyz"), rng.choice([None, None, 1, 2, 3])) for _ in range(25)]
        rows += [(f"t{t}", o, n, g, None, "w") for o, (n, g) in enumerate(seq)]
        want |= {(f"t{t}", o): v for o, v in enumerate(occurrences(seq))}
    ev = spark.createDataFrame(rows, "traj_id string, ord int, node_id string, occurrence int, transition_kind string, workflow string")
    nodes = spark.createDataFrame([("w", n) for n in "xyz"], "workflow string, id string")
    assert {(r.traj_id, r.ord): r.occ for r in events.known_events(ev, nodes).collect()} == want


def test_tool_semantics(spark):
    rows = [
        ("exec.pytest", '{"command": "pytest -q"}', "12 passed, 1 skipped", None, 0, "{}"),
        ("functions.bash", "ls -l", None, None, 2, None),
        ("read_file", '{"file": "a.py"}', None, "missing", None, None),
        ("apply_patch", "diff", None, None, None, None),
        ("browser.search", '{"query": "q"}', None, None, None, None),
        ("http_request", '{"url": "u", "method": "post"}', '{"status": 404}', None, None, None),
        ("custom", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "tool_name string, arguments string, output string, error string, exit_code int, metadata string")
    call = tools.Call.of()
    got = df.withColumn("h", tools.handler_name(call)).withColumn("x", tools.semantics(call, F.col("h"))).select("h", "x.*").collect()
    assert [r.h for r in got] == ["pytest", "shell", "file_read", "file_write", "browser", "http", "generic"]
    assert got[0].evidence == "pytest command: pytest -q; pytest result: 12 passed, 1 skipped; exit code: 0" and got[0].outcome == "tests pass"
    assert got[1].evidence == "command: ls -l; exit code: 2" and got[1].status == "failure"
    assert got[2].action == "read file a.py" and got[2].outcome == "file read failed"
    assert got[3].action == "modify repository files"
    assert (got[4].action, got[4].evidence) == ("search the web", "browser target: q")
    assert (got[5].action, got[5].evidence, got[5].status) == ("send POST HTTP request", "url: u; status code: 404", "failure")
    assert got[6].action == "use tool custom"
    own = {"Custom": lambda c: tools.shell_semantics(c)}
    assert df.select(tools.handler_name(call, own).alias("h")).collect()[6].h == "custom:Custom"


def test_payloads():
    assert payloads.redacted({"a": [{"api_key": 1, "status_code": 2}], "my_token": "x"}) == {"a": [{"api_key": "[REDACTED]", "status_code": 2}], "my_token": "[REDACTED]"}
    assert payloads.contains({"a": {"b": 1, "c": 2}}, {"a": {"b": 1}}) and not payloads.contains({"a": 1}, {"a": {"b": 1}})
    assert payloads.resolve_steps('{"metadata": {"actions": ["b"]}}', None) == ([["b"]], "extra_info.metadata.actions")
    assert payloads.resolve_steps(None, "a, b；c\nd") == ([], None)
    assert payloads.resolve_steps({"reference_steps": "a, b；c\nd"}, None)[0] == [["a"], ["b"], ["c"], ["d"]]
    assert payloads.resolve_steps(None, '[{"action": "x"}, {"actions": ["y", " "]}, {"z": 1}]') == ([["x"], ["y"]], "ground_truth")
    assert payloads.resolve_steps({"own": {"s": ["q"]}}, None, ["own.s"])[1] == "extra_info.own.s"


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    steps = F.array(F.array(F.lit("run tests")), F.array(F.lit("locate root cause")))
    assert [one(X.step_tier(F.lit(t))) for t in ("read the issue", "run tests now", "explain why", "", None)] == ["proxy", "observable", "reasoning", "proxy", "proxy"]
    assert one(X.has_trace(F.lit("I will locate root cause because"), steps)) and not one(X.has_trace(F.lit("I will locate root cause"), steps))
    assert one(X.intention_fraction(F.lit("I will run tests. Then rest."), steps)) == 0.5
    assert one(X.split_think(F.lit("<think>a</think> b"))) == ("a", "b")
    assert one(X.repetition(X.long_pieces(F.lit("spam spam spam spam"))))["penalty"] == pytest.approx(-1.4)
    assert one(X.lexical_coverage(F.lit("Straße  gut"), F.array(F.array(F.lit("STRASSE GUT")), F.array(F.lit("x"))))) == 0.5
    assert one(experiments.token_rewards(F.lit(6), F.array(*map(F.lit, (0, 3))), F.array(*map(F.lit, (-0.5, 1.25))))) == [-0.5, 0, 0, 1.25, 0, 0]


def test_ranking(spark):
    df = spark.createDataFrame([(0.9, 1, "g"), (0.9, 0, "g"), (0.5, 1, "g"), (0.1, 0, "h"), (0.3, None, "h")], "score double, label int, pair_id string")
    r = quality.ranking(df).first()
    assert (r["count"], r.auroc) == (4, pytest.approx((0.5 + 1 + 0 + 1) / 4)) and r.average_precision == pytest.approx((0.5 + 2 / 3) / 2)
    p = quality.pairwise(df).first()
    assert (p.groups, p.comparisons, p.accuracy) == (1, 2, 0.25)
    empty = quality.ranking(df.limit(0)).first()
    assert empty.auroc is None and empty["count"] == 0
    assert quality.pairwise(df.limit(0)).first().groups == 0


def test_cosines_of_all_queries_with_all_rows(spark, tmp_path):
    rng = random.Random(3)
    # the head of the hundred of 205 and 207 is absent; 300 has no vector
    rows = [(i, [rng.uniform(-1, 1) for _ in range(3)]) for i in (0, 1, 99, 100, 101, 205, 207, 400)] + [(300, None)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.query_id, r.vec_id): r.cosine for r in Q.cosine_matrix(spark, str(tmp_path)).collect()}
    some = [(i, v) for i, v in rows if v]
    want = {(a, b): sum(x * y for x, y in zip(v, w, strict=True)) for a, v in some if a % 100 == 0 for b, w in some}
    assert got == pytest.approx(want, abs=2e-5) and len(got) == 24
    vectors = spark.read.parquet(str(tmp_path / "embeddings.parquet"))
    assert Q.embed.cosines(vectors, vectors, query_block=3, row_block=2).count() == 64
    assert Q.embed.cosines(vectors.limit(0), vectors).count() == 0


def test_all_distinct_texts_are_encoded(spark, tmp_path):
    long = " ".join(f"check{i} the column" for i in range(500))
    rows = [("a", dt.datetime(2025, 1, 1), [["open it", "search"], ["open it"]], "open it"), ("b", dt.datetime(2025, 1, 1), [["search"]], long),
            ("a", dt.datetime(2024, 1, 1), [["old"]], "old"), ("c", dt.datetime(2025, 1, 1), None, None)]
    cols = "id string, ingested_at timestamp, reference_steps array<array<string>>, response string"
    spark.createDataFrame(rows, cols).write.parquet(str(tmp_path / "demo_samples.parquet"))
    want = {("query", t) for t in ("open it", "search")} | {("passage", "open it")}
    want |= {("passage", long[s:e]) for size in ((128, 64), (48, 24)) for s, e in Q.windows.spans(long, *size)}
    got = [(r.role, r.text_md5) for r in Q.embed_distinct(spark, str(tmp_path)).collect()]
    assert len(got) == len(set(got)) > 350 and set(got) == {(role, hashlib.md5(t.encode()).hexdigest()) for role, t in want}


def test_attempts_are_scored_on_all_windows(spark, sf, monkeypatch):
    used, score = [], Q.traces.score_traces
    monkeypatch.setattr(Q.traces, "score_traces", lambda *a, **kw: used.append(kw["scorer"]) or score(*a, **kw))
    assert Q.trace_rewards(spark, sf).columns == ["traj_id", "attempt", "part", "score", "required_coverage", "order_rate", "state_score", "valid", "validity", "violations"]
    text = "an event of a long attempt " * 600
    chosen, stats = Q.windows.windows_of(text, *used[0].fine, used[0].max_windows)
    assert len(chosen) == len(Q.windows.spans(text.strip(), *used[0].fine)) > 256 and not stats[3] and stats[5] == 1.0


def test_readers(spark, tmp_path):
    p = tmp_path / "s.jsonl"
    p.write_text('{"id": "a", "response": "r", "reference_steps": ["x", ["y", "z"]], "label": "genuine"}\n\n{"response": null}\n')
    rows = readers.read_samples(spark, str(p), strict=False).collect()
    assert len(rows) == 1 and rows[0].reference_steps == [["x"], ["y", "z"]] and rows[0].label == 1 and rows[0].subtype == "unspecified"
    e = tmp_path / "e.jsonl"
    e.write_text('{"traj_id": "t", "events": [{"id": "q", "action": "a", "trusted": true, "tool": "sh"}, {"action": "b"}]}\n')
    ev = readers.read_events(spark, str(e)).orderBy("ord").collect()
    assert [r.event_id for r in ev] == ["q", "event-1"] and not ev[0].trusted and ev[0].tool_name == "sh"
    readers.write_report(spark.createDataFrame([(1, 0.5)], "a int, b double"), str(tmp_path / "r"))
    assert "0.5000" in readers.report_text(spark.read.json(str(tmp_path / "r")))


def test_validation_of_a_retry(spark):
    nodes = spark.createDataFrame([("w", "a", 1), ("w", "b", 2), ("w", "c", 1)], "workflow string, id string, max_visits int")
    edges = spark.createDataFrame([("w", 0, "a", "b", "forward", 1), ("w", 1, "b", "b", "retry", 1), ("w", 2, "b", "c", "forward", 1)],
                                  "workflow string, edge_index int, source string, target string, kind string, max_traversals int")
    defs = spark.createDataFrame([("w", "a", ["c"])], "name string, start string, terminals array<string>")
    now = dt.datetime(2025, 1, 1)
    def event(t, o, n, occ=None, trusted=True):
        return (t, o, f"e{o}", n, occ, None, trusted, "runtime", '{"workflow": "w"}', now, "success", "x", None, None, None, None, None, None, None)

    cols = "traj_id string, ord int, event_id string, node_id string, occurrence int, transition_kind string, trusted boolean, source string, metadata string, ingested_at timestamp, status string, action string, evidence string, outcome string, tool_name string, tool_input string, tool_output string, state_before string, state_after string"
    raw = spark.createDataFrame([event("ok", 0, "a"), event("ok", 1, "b", 1), event("ok", 2, "b", 2), event("ok", 3, " c "),
                                 event("bad", 0, "b"), event("bad", 1, "a", trusted=False), event("bad", 2, "zz"), event("bad", 3, None)], cols)
    ev = events.current_events(raw)
    checked = events.checks(ev, nodes, edges, defs)
    assert {r.traj_id: r.valid for r in events.validity(checked).collect()} == {"ok": True, "bad": False}
    assert {r.reason for r in events.violations(checked).collect()} == {
        "wrong_start:b", "illegal_transition:b->a", "untrusted_event:e1", "unknown_node:zz", "missing_node_id:e3", "terminal_not_reached:a",
    }
    text = {r.ord: r.text for r in events.rendered(ev.filter("traj_id = 'ok'")).collect()}[1]
    assert text == "<trace_event id=e1 source=runtime status=success node=b occurrence=1>\nAction: x\n</trace_event>"


def test_chunks_change_nothing(spark):
    rng = random.Random(12)
    rows = []
    for t in range(6):
        for o in range(40):
            node = rng.choice(["a", "b", "c", "zz", None])
            rows.append((f"t{t}", o, f"e{rng.randint(0, 60)}", node, rng.choice([None, None, 1, 2, 3]), rng.choice([None, "forward", "retry"]), rng.random() < 0.9, "runtime", "w"))
    cols = "traj_id string, ord int, event_id string, node_id string, occurrence int, transition_kind string, trusted boolean, source string, workflow string"
    ev = spark.createDataFrame(rows, cols)
    nodes = spark.createDataFrame([("w", n, 4) for n in "abc"], "workflow string, id string, max_visits int")
    edges = spark.createDataFrame([("w", k, x, y, kind, 2) for k, (x, y, kind) in enumerate([("a", "b", "forward"), ("b", "a", "retry"), ("a", "b", "retry"), ("b", "c", "forward"), ("c", "a", "forward")])],
                                  "workflow string, edge_index int, source string, target string, kind string, max_traversals int")
    defs = spark.createDataFrame([("w", "a", ["c"])], "name string, start string, terminals array<string>")
    apart = ev.withColumn("ord", F.col("ord") * 30_000)
    some = ev.withColumn("ord", F.when(F.col("traj_id") < "t3", F.col("ord") * 30_000).otherwise(F.col("ord")))
    assert [[short for _, short in by_length(e, "traj_id", "ord")] for e in (ev, apart, some, ev.limit(0))] == [[True], [True, False], [True, False], [True]]
    got = [sorted((r.traj_id, r.passed, r.reason or "") for r in events.checks(e, nodes, edges, defs).collect()) for e in (ev, apart, some)]
    assert got[0] == got[1] == got[2] and len(got[0]) > 500
    steps = spark.createDataFrame([("s", o * 30_000, float(o % 7)) for o in range(9)], "s string, o int, potential double")
    from trailmark.operators.workflow import shaped

    assert sorted(shaped(steps, "s", "o").collect()) == sorted(shaped(steps, "s", "o", single=True).collect())


NAMES = ["normalize_steps", "resolve_steps", "sliding_windows", "window_coverage", "order_rate", "monotonic_score", "trace_gate", "confidence_routing", "tool_dispatch",
         "pytest_semantics", "visit_islands", "trace_violations", "auroc", "pairwise_accuracy", "subtype_report", "dead_ends", "token_rewards",
         "linear_score", "coarse_to_fine", "linear_routing", "best_trajectory", "final_scores", "final_scores_lexical", "trace_walks", "adapted_events", "quality_report",
         "graph_unrolling", "path_enumeration", "schema_faults", "cosine_matrix", "embed_distinct"]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, sf, name):
    import os

    con = duckdb.connect()
    for f in os.listdir(sf):
        con.execute(f"create view {f[:-8]} as select * from '{sf}/{f}'")
    key = lambda v: "" if v is None or v != v else f"{float(v):.5f}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)
    mine = Q.QUERIES[name](spark, sf)
    cols = sorted(mine.columns)
    a = sorted(tuple(key(r[c]) for c in cols) for r in mine.collect())
    got = con.execute(Q.SQL[name])
    at = [[d[0] for d in got.description].index(c) for c in cols]
    b = sorted(tuple(key(r[i]) for i in at) for r in got.fetchall())
    assert a == b
