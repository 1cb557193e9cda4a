"""The queries of the training-data operators and their SQL, where SQL can state them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import lookalike, mixing, packing, pairs, pieces, repetition, runs, subjects
from trailmark.plans.delivery import latest_delivery

Query = Callable[[SparkSession, str], DataFrame]


def _read(spark: SparkSession, folder: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{table}.parquet")


# ---------------------------------------------------------------- 1 pieces


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Oversized responses; only ids, times and verdicts are shuffled to find the latest delivery."""
    rows, limits = _read(spark, folder, "demo_samples"), _read(spark, folder, "piece_limits")
    found = pieces.split_oversized(rows, limits, keep=("ingested_at",)).filter("piece_index = 0")
    verdict = F.when(F.col("longest_stretch") > F.col("max_chars"), "forced").otherwise("boundary")
    long = found.select("id", F.col("ingested_at").alias("t"), verdict.alias("cut"))
    # a later delivery that is not oversized takes an earlier verdict back
    every = rows.select("id", F.col("ingested_at").alias("t"), F.lit(None).cast("string").alias("cut"))
    latest = long.unionByName(every).filter("id is not null").groupBy("id").agg(F.max(F.struct("t", "cut")).alias("x"))
    return latest.select("id", F.col("x.cut").alias("cut")).filter("cut is not null")


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    """All pieces of the latest deliveries."""
    rows = latest_delivery(_read(spark, folder, "demo_samples").select("id", "response", "subtype", "ingested_at"), ["id"], "ingested_at")
    made = pieces.split_oversized(rows, _read(spark, folder, "piece_limits"))
    return made.select("id", "piece_index", "n_pieces", "start_char", "end_char", "piece", "cut")


def p1_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """What every cut text must show: its pieces without their overlaps are the text, none is too long, and neighbours share the overlap."""
    rows = latest_delivery(_read(spark, folder, "demo_samples").select("id", "response", "subtype", "ingested_at"), ["id"], "ingested_at")
    limits = _read(spark, folder, "piece_limits")
    own = pieces.split_oversized(rows, limits, keep=("subtype",)).filter("id is not null")
    rules = limits.select(F.coalesce("subtype", F.lit("default")).alias("k"), F.col("overlap_chars").alias("o"))
    kinds = {r["k"]: r["o"] for r in rules.limit(1_000).collect()}  # a row per subtype
    overlap = F.coalesce(F.create_map(*[F.lit(x) for k in kinds.items() for x in k])[F.coalesce("subtype", F.lit("default"))], F.lit(kinds.get("default")))
    per = own.groupBy("id", overlap.alias("o"), "max_chars").agg(F.array_sort(F.collect_list(F.struct("piece_index", "start_char", "end_char", "piece"))).alias("p"))
    text = F.aggregate("p", F.struct(F.lit("").alias("t"), F.lit(0).alias("e")), lambda s, x: F.struct(F.concat(s["t"], F.substring(x["piece"], s["e"] - x["start_char"] + 1, F.length(x["piece"]))).alias("t"), x["end_char"].alias("e")))["t"]
    pairs_ = F.zip_with(F.slice("p", F.lit(1), F.size("p") - 1), F.slice("p", F.lit(2), F.size("p") - 1), lambda a, b: (a["end_char"] - b["start_char"] == F.least(F.col("o"), a["end_char"])) & (b["end_char"] > a["end_char"]))
    return per.select("id", F.md5(text).alias("text_md5"), F.forall("p", lambda x: F.length(x["piece"]) <= F.col("max_chars")).alias("within"), F.forall(pairs_, lambda x: x).alias("overlapped"),
                      (F.size("p") >= 2).alias("cut"))


P1_ROUND_SQL = """
with latest as (
  select id, response, subtype from demo_samples where id is not null
  qualify row_number() over (partition by id order by ingested_at desc nulls last) = 1
), sized as (
  select d.id, d.response, coalesce(l.max_chars, (select max_chars from piece_limits where subtype = 'default')) as max_chars
  from latest d left join piece_limits l on l.subtype = coalesce(d.subtype, 'default')
)
select id, md5(response) as text_md5, true as within, true as overlapped, true as cut from sized where length(response) > max_chars
"""
P1_SQL = """
with latest as (
  select id, response, subtype from demo_samples where id is not null
  qualify row_number() over (partition by id order by ingested_at desc nulls last) = 1
), sized as (
  select d.id, d.response,
         coalesce(l.max_chars, (select max_chars from piece_limits where subtype = 'default')) as max_chars
  from latest d left join piece_limits l on l.subtype = coalesce(d.subtype, 'default')
)
select id, case when list_max(list_transform(regexp_split_to_array(response, '[ \n。，；]'), lambda x: length(x))) > max_chars
                then 'forced' else 'boundary' end as cut
from sized where length(response) > max_chars
"""


# ------------------------------------------------------------ 2 look-alikes


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    rows = _read(spark, folder, "demo_samples")
    base = [F.col("id"), F.col("ingested_at").alias("delivered")]
    both = F.array(
        F.struct(F.lit("response").alias("field"), F.lit(None).cast("string").alias("scope"), F.col("response").alias("text")),
        F.struct(F.lit("reference_steps").alias("field"), F.col("pair_id").alias("scope"), lookalike.steps_text(F.col("reference_steps")).alias("text")),
    )
    # steps are compared within a pair; responses count only with a letter or digit
    split = rows.select(*base, F.explode(both).alias("x")).select("id", "delivered", "x.*")
    counts = F.when(F.col("field") == "response", F.col("text").rlike(lookalike.WORDLY)).otherwise(F.col("scope").isNotNull())
    return split.withColumn("text", F.when(counts, F.col("text")))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Membership: the ids of every class of equal reading with more than one stored form."""
    return lookalike.lookalike_classes(_texts(spark, folder))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return lookalike.lookalike_pairs(p2_classes(spark, folder))


def p2_normalized(spark: SparkSession, folder: str) -> DataFrame:
    """Every response in its consistent form."""
    rows = latest_delivery(_read(spark, folder, "demo_samples").select("id", "response", "ingested_at"), ["id"], "ingested_at")
    return lookalike.normalize_text(rows, "id", "response").select("id", "skeleton")


# ------------------------------------------------------------ 3 broken pairs


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return pairs.broken_pairs(_read(spark, folder, "demo_samples"))


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """How much of every response is the wording of its steps, and its defect."""
    rows = latest_delivery(_read(spark, folder, "demo_samples").select("id", "response", "reference_steps", "ingested_at"), ["id"], "ingested_at")
    return pairs.pair_measures(rows).withColumn("copied_coverage", F.round("copied_coverage", 6))


# -------------------------------------------------------------------- 4 runs


def p4_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Every event or run of events, with number and duration."""
    made = runs.collapse_runs(_read(spark, folder, "trace_events"))
    return made.select("traj_id", "first_ord", "last_ord", "n_events", "event_number", "node", "occurrence", F.round("duration_seconds", 6).alias("duration_seconds"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return runs.collapse_runs(_read(spark, folder, "trace_events")).filter("n_events >= 2").select("traj_id", "first_ord", "last_ord")


_P4_RUNS = r"""
with ev as (
  select traj_id, ord, nullif(regexp_extract(event_id, '([0-9]+)', 1), '') as digits, ts,
         lower(regexp_replace(regexp_replace(node_id, '^\s+|\s+$', '', 'g'), '[\s_-]+', '_', 'g')) as node, occurrence as occ
  from trace_events where traj_id is not null and ord is not null
  qualify row_number() over (partition by traj_id, ord order by ingested_at desc nulls last) = 1
), numbered as (
  select *, case when digits is not null then regexp_replace(digits, '^0+([0-9])', '\1') end as number from ev
), marked as (
  select *, case when number = lag(number) over w and node is not distinct from lag(node) over w
             and (occ is null or lag(occ) over w is null or occ = lag(occ) over w) then 0 else 1 end as fresh
  from numbered window w as (partition by traj_id order by ord)
), grouped as (
  select *, sum(fresh) over (partition by traj_id order by ord) as run from marked
)
select traj_id, cast(min(ord) as int) as first_ord, cast(max(ord) as int) as last_ord, count(*) as n_events,
       min(number) as event_number, min(node) as node, max(occ) as occurrence,
       round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) as duration_seconds
from grouped group by traj_id, run
"""
P4_RUNS_SQL = _P4_RUNS
P4_SQL = f"select traj_id, first_ord, last_ord from ({_P4_RUNS}) where n_events >= 2"


# -------------------------------------------------------------- 5 repetition


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return repetition.repeated_rows(_read(spark, folder, "demo_samples"), "id", "response", "ingested_at")


def p5_report(spark: SparkSession, folder: str) -> DataFrame:
    """The measures of every response and the rules that fire."""
    rows = latest_delivery(_read(spark, folder, "demo_samples").select("id", "response", "ingested_at"), ["id"], "ingested_at")
    report = repetition.repetition_report(rows, "id", "response")
    return report.select(
        "id", "n_words", "repeated_words", F.round("repeated_word_share", 6).alias("repeated_word_share"), F.round("symbol_ratio", 6).alias("symbol_ratio"),
        F.round("stopword_ratio", 6).alias("stopword_ratio"), F.round("duplicate_line_share", 6).alias("duplicate_line_share"), F.concat_ws(";", "fired").alias("fired"),
    )


P5_SQL = r"""
with latest as (
  select id, response from demo_samples where id is not null
  qualify row_number() over (partition by id order by ingested_at desc nulls last) = 1
), worded as (
  select id, regexp_extract_all(lower(coalesce(response, '')), '\p{Han}|(?:[\p{Latin}\p{Greek}\p{Cyrillic}\p{Armenian}\p{M}\p{N}µªº])+') as w from latest
), shingles as (
  select id, len(w) as n, i, array_to_string(w[i : i + 4], ' ') as s
  from worded, unnest(generate_series(1, len(w) - 4)) as u(i)
), starts as (
  select id, n, i from shingles qualify row_number() over (partition by id, s order by i) > 1
), covered as (
  select id, n, least(5, coalesce(lead(i) over (partition by id order by i) - i, 5)) as c from starts
)
select id from covered group by id, n having sum(c) >= 0.4 * n
"""


_STOP = ", ".join(f"'{w}'" for w in repetition.STOPWORDS)
P5_REPORT_SQL = rf"""
with latest as (
  select id, coalesce(response, '') as t from demo_samples
  qualify row_number() over (partition by id order by ingested_at desc nulls last) = 1
), worded as (
  select id, t, regexp_extract_all(lower(t), '\p{{Han}}|(?:[\p{{Latin}}\p{{Greek}}\p{{Cyrillic}}\p{{Armenian}}\p{{M}}\p{{N}}µªº])+') as w from latest
), shingles as (
  select id, i, array_to_string(w[i : i + 4], ' ') as s from worded, unnest(generate_series(1, len(w) - 4)) as u(i)
), starts as (
  select id, i from shingles qualify row_number() over (partition by id, s order by i) > 1
), covered as (
  select id, least(5, coalesce(lead(i) over (partition by id order by i) - i, 5)) as c from starts
), sums as (select id, sum(c) as c from covered group by id),
measured as (
  select d.id, len(w) as n, coalesce(s.c, 0) as rep, coalesce(s.c, 0) / greatest(len(w), 1) as share,
    length(regexp_replace(t, '[\p{{L}}\p{{M}}\p{{N}}\s\x{{0085}}\x{{00A0}}\x{{1680}}\x{{2000}}-\x{{200A}}\x{{2028}}\x{{2029}}\x{{202F}}\x{{205F}}\x{{3000}}]+', '', 'g')) / greatest(length(t), 1) as symbols,
    len(list_filter(w, lambda x: x in ({_STOP}))) / greatest(len(w), 1) as stops,
    list_filter(string_split(t, chr(10)), lambda x: trim(x) <> '') as lines,
    coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) / greatest(len(w), 1) as mean_length
  from worded d left join sums s on s.id is not distinct from d.id
), final as (select *, case when len(lines) > 0 then 1 - len(list_distinct(lines)) / len(lines) else 0.0 end as dup from measured)
select id, cast(n as int) as n_words, cast(rep as int) as repeated_words, round(share, 6) as repeated_word_share, round(symbols, 6) as symbol_ratio, round(stops, 6) as stopword_ratio, round(dup, 6) as duplicate_line_share,
  array_to_string(list_filter([case when share >= 0.40 then 'repeated_word_share>=0.4' end, case when n < 3 then 'n_words<3' end, case when n > 100000 then 'n_words>100000' end, case when symbols > 0.50 then 'symbol_ratio>0.5' end,
    case when stops < 0.01 then 'stopword_ratio<0.01' end, case when dup > 0.30 then 'duplicate_line_share>0.3' end, case when mean_length > 20 then 'mean_word_length>20' end], lambda x: x is not null), ';') as fired from final
"""


# ----------------------------------------------------------------- 6 packing


def _capacity(spark: SparkSession, folder: str, kind: str = "train_block") -> int:
    return _read(spark, folder, "containers").filter(F.col("container_kind") == kind).first()["capacity_tokens"]


def p6_containers(spark: SparkSession, folder: str) -> DataFrame:
    """Contents and fill of every container."""
    return packing.pack(_read(spark, folder, "documents"), _capacity(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_containers(spark, folder).filter("n_parts > 1").select("doc_id").distinct()


# ------------------------------------------------------------------ 7 mixing


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    sized = mixing.sized_sources(_read(spark, folder, "documents"))
    return mixing.mix_plan(sized, _read(spark, folder, "mix_targets")).filter("not reachable").select("mix_id", "source")


def p7_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The chosen documents of every mix with their repeats."""
    sized = mixing.sized_sources(_read(spark, folder, "documents"))
    return mixing.draw_mix(sized, mixing.mix_plan(sized, _read(spark, folder, "mix_targets")))


def p7_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The shares that every mix reaches."""
    sized = mixing.sized_sources(_read(spark, folder, "documents"))
    plan = mixing.mix_plan(sized, _read(spark, folder, "mix_targets"))
    return mixing.reached_shares(mixing.draw_mix(sized, plan), plan)


# ---------------------------------------------------------------- 8 subjects


def _subjects(spark: SparkSession, folder: str) -> DataFrame:
    return subjects.document_subjects(_read(spark, folder, "documents"), _read(spark, folder, "subject_labels"), _read(spark, folder, "subject_areas"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _subjects(spark, folder).select("doc_id", "subject")


def p8_composition(spark: SparkSession, folder: str) -> DataFrame:
    """Documents per subject and their share of the corpus."""
    return subjects.corpus_composition(_subjects(spark, folder), _read(spark, folder, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        p1_found, p1_pieces, p1_round_trip, p2_found, p2_classes, p2_normalized, p3_found, p3_report, p4_found, p4_runs, p5_found, p5_report,
        p6_found, p6_containers, p7_found, p7_mix, p7_shares, p8_found, p8_composition,
    )
}
SQL: dict[str, str] = {"p1_found": P1_SQL, "p1_round_trip": P1_ROUND_SQL, "p5_report": P5_REPORT_SQL, "p4_found": P4_SQL, "p4_runs": P4_RUNS_SQL, "p5_found": P5_SQL}
