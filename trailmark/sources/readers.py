"""Readers and writers of samples, suites, workflows and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.functions.text import coerced_label
from trailmark.functions.tools import record

SAMPLE = "id string, response string, reference_steps array<array<string>>, label int, subtype string, pair_id string"
#: The spellings of a label.
LABELS = ["1", "true", "positive", "genuine", "0", "false", "negative", "hard_negative"]
EVENT = (
    "event_id string, id string, action string, node_id string, occurrence int, evidence string, outcome string, status string, source string, trusted boolean, "
    "transition_kind string, tool_name string, tool string, tool_input string, tool_output string, state_before string, state_after string, metadata string"
)
SUITE = (
    "domains array<struct<name string, environment string, train_split string, evaluation_split string, primary_metric string, max_turns int>>, "
    "ablations array<struct<name string, alignment_mode string, turn_potential boolean, outcome_weight double, process_weight double>>, seeds array<int>"
)
WORKFLOW = (
    "name string, start string, terminals array<string>, stage_weights map<string,double>, "
    "nodes array<struct<id string, action string, stage string, required boolean, evidence string, outcome string, weight double, max_visits int, preconditions string, postconditions string>>, "
    "edges array<struct<source string, `from` string, target string, `to` string, kind string, max_traversals int>>"
)


def read_samples(spark: SparkSession, path: str, *, strict: bool = True) -> DataFrame:
    """Labelled samples from JSON lines, or from a ``.json`` file whose root is a list.

    Strict reading fails on a row that does not fit or has an unknown label;
    lenient reading leaves out rows without a response or steps (:func:`skipped`
    counts them) and drops unknown labels. A scalar step becomes one candidate. Rows
    without an id are named by their position, a missing subtype is ``unspecified``.
    """
    reader = spark.read.schema("id string, response string, reference_steps array<string>, label string, subtype string, pair_id string")
    reader = reader.option("mode", "FAILFAST" if strict else "PERMISSIVE").option("multiLine", path.endswith(".json"))
    raw = reader.json(path)
    # a step is a text or a list: a list arrives as its JSON text
    step = lambda s: F.coalesce(F.from_json(F.when(s.rlike(r"^\s*\["), s), "array<string>"), F.array(s))
    rows = raw.withColumn("reference_steps", F.transform("reference_steps", step))
    if not strict:
        rows = rows.filter("response is not null and reference_steps is not null")
    known = F.lower("label").isin(*LABELS)
    return rows.select(
        F.coalesce("id", F.concat(F.lit("sample-"), F.monotonically_increasing_id().cast("string"))).alias("id"),
        "response",
        "reference_steps",
        (coerced_label(F.col("label")) if strict else F.when(known, coerced_label(F.when(known, F.col("label"))))).alias("label"),
        F.coalesce("subtype", F.lit("unspecified")).alias("subtype"),
        "pair_id",
    )


def skipped(spark: SparkSession, path: str) -> DataFrame:
    """``rows, skipped``: how many rows a lenient reading of :func:`read_samples` leaves out."""
    raw = spark.read.schema("response string, reference_steps array<string>").option("multiLine", path.endswith(".json")).json(path)
    return raw.agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("response").isNull() | F.col("reference_steps").isNull(), 1)).alias("skipped"))


def append_samples(own: DataFrame, extra: DataFrame, subtype: str = "external") -> DataFrame:
    """Both tables' rows; columns that one lacks are null, a missing subtype of the extra rows is filled."""
    return own.unionByName(extra.withColumn("subtype", F.coalesce("subtype", F.lit(subtype))), allowMissingColumns=True)


def read_rlvr(spark: SparkSession, path: str) -> DataFrame:
    """Training rows from Parquet: ``row_id, data_source, ability, ground_truth, extra_info, solution_str``."""
    return spark.read.parquet(path).select("row_id", "data_source", "ability", F.col("reward_model.ground_truth").alias("ground_truth"), "extra_info", "solution_str")


def read_suite(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Domains, ablations and seeds of a suite in one JSON document."""
    doc = spark.read.schema(SUITE).option("multiLine", True).json(path)
    domains = doc.select(F.explode("domains").alias("x")).select(F.col("x.name").alias("domain"), "x.environment", "x.train_split", "x.evaluation_split", "x.primary_metric", "x.max_turns")
    ablations = doc.select(F.explode("ablations").alias("x")).select(F.col("x.name").alias("ablation"), "x.alignment_mode", "x.turn_potential", "x.outcome_weight", "x.process_weight")
    return domains, ablations, doc.select(F.explode(F.coalesce("seeds", F.array(F.lit(1), F.lit(2), F.lit(3)))).alias("seed"))


def read_workflows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Nodes, edges and definitions from JSON documents; edges may say ``from``/``to``."""
    doc = spark.read.schema(WORKFLOW).option("multiLine", True).json(path)
    texts = lambda c: F.when(c.isNotNull(), F.coalesce(F.from_json(F.when(c.rlike(r"^\s*\["), c), "array<string>"), F.array(c)))
    n = doc.select(F.col("name").alias("workflow"), F.posexplode("nodes").alias("node_index", "x"))
    nodes = n.select(
        "workflow", "node_index", F.trim("x.id").alias("id"), texts(F.col("x.action")).alias("action"), F.coalesce(F.nullif(F.trim("x.stage"), F.lit("")), F.lit("default")).alias("stage"),
        F.coalesce("x.required", F.lit(True)).alias("required"), texts(F.col("x.evidence")).alias("evidence"), texts(F.col("x.outcome")).alias("outcome"),
        F.coalesce("x.weight", F.lit(1.0)).alias("weight"), F.coalesce("x.max_visits", F.lit(1)).alias("max_visits"), "x.preconditions", "x.postconditions",
    )
    e = doc.select(F.col("name").alias("workflow"), F.posexplode("edges").alias("edge_index", "x"))
    edges = e.select(
        "workflow", "edge_index", F.trim(F.coalesce("x.source", "x.from")).alias("source"), F.trim(F.coalesce("x.target", "x.to")).alias("target"),
        F.lower(F.trim(F.coalesce("x.kind", F.lit("forward")))).alias("kind"), F.coalesce("x.max_traversals", F.lit(1)).alias("max_traversals"),
    )
    return nodes, edges, doc.select("name", "start", "terminals", "stage_weights")


def read_events(spark: SparkSession, path: str, *, allow_trust: bool = False) -> DataFrame:
    """Events of one trajectory per JSON line (an array ``events`` and a ``traj_id``), in the order of the array.

    ``id`` and ``tool`` are accepted for ``event_id`` and ``tool_name``; trust
    that a file claims counts only if allowed.
    """
    doc = spark.read.schema(f"traj_id string, events array<struct<{EVENT.replace(' string', ': string').replace(' int', ': int').replace(' boolean', ': boolean')}>>").json(path)
    e = doc.select("traj_id", F.posexplode("events").alias("ord", "x"))
    return e.select(
        "traj_id", "ord", F.coalesce("x.event_id", "x.id", F.concat(F.lit("event-"), F.col("ord").cast("string"))).alias("event_id"), F.coalesce("x.action", F.lit("")).alias("action"),
        "x.node_id", "x.occurrence", "x.evidence", "x.outcome", F.coalesce("x.status", F.lit("success")).alias("status"), F.coalesce("x.source", F.lit("model")).alias("source"),
        (F.lit(allow_trust) & F.coalesce("x.trusted", F.lit(False))).alias("trusted"), "x.transition_kind", F.coalesce("x.tool_name", "x.tool").alias("tool_name"),
        "x.tool_input", "x.tool_output", "x.state_before", "x.state_after", "x.metadata",
    )


def read_tool_calls(spark: SparkSession, path: str) -> DataFrame:
    """Tool calls of one trajectory per JSON line (an array ``tool_calls`` and a ``traj_id``), in the columns of a call table.

    Records may use the names of other runtimes; without an id a call is named
    by its place. Records without a tool name or with an occurrence below 1 fail.
    """
    lines = spark.read.schema("traj_id string, tool_calls array<string>").json(path)
    each = lines.select("traj_id", F.posexplode("tool_calls").alias("ord", "text"))
    call, rest = record(F.col("text"), F.col("ord"))
    ok = (call.tool_name != "") & F.coalesce(rest["occurrence"] > 0, F.lit(True))
    return each.select(
        "traj_id", "ord", rest["call_id"].alias("call_id"), F.when(ok, call.tool_name).otherwise(F.raise_error("a tool record has no name or a bad occurrence").cast("string")).alias("tool_name"),
        call.arguments.alias("arguments"), call.output.alias("output"), call.error.alias("error"), call.exit_code.alias("exit_code"),
        *[rest[c].alias(c) for c in ("node_id", "occurrence", "transition_kind", "state_before", "state_after")], call.metadata.alias("metadata"),
    )


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON lines in one file; reports hold a bounded number of rows."""
    report.coalesce(1).write.mode("overwrite").json(path)


def report_text(report: DataFrame, rows: int = 50) -> str:
    """The first rows of a report as an aligned table."""
    head = report.limit(rows).collect()
    names = report.columns
    cells = [names] + [["-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v) for v in r] for r in head]
    widths = [max(len(r[i]) for r in cells) for i in range(len(names))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths, strict=True)).rstrip() for r in cells)
