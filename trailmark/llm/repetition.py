"""Problem 5: how much of a text says what it said before.

A table of rules (measure, comparison, threshold) is compiled into one Spark
projection. The measures, among them the share of words that lie in a repeated
stretch of five or more, are built-in expressions: no user function, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words in the shortest stretch that counts as repeated.
STRETCH = 5
#: Frequent words of the languages in the data.
STOPWORDS = "the be to of and that have with in is it for der die das und ist nicht mit ein eine le la les de des et est que el los en y un una por".split()
#: Default thresholds: measure, comparison under which the rule fires, threshold.
RULES = [
    ("repeated_word_share", ">=", 0.40),
    ("n_words", "<", 3),
    ("n_words", ">", 100_000),
    ("symbol_ratio", ">", 0.50),
    ("stopword_ratio", "<", 0.01),
    ("duplicate_line_share", ">", 0.30),
    ("mean_word_length", ">", 20),
]
_WORD = r"(?U)\p{IsHan}|[\p{L}\p{M}\p{N}&&[^\p{IsHan}]]+"


def words(text: Column) -> Column:
    """Runs of letters or digits in lower case; each Chinese character is a word."""
    return F.regexp_extract_all(F.lower(text), F.lit(_WORD), F.lit(0))


def repeated_words(stretches: Column) -> Column:
    """Words covered by stretches whose hash occurs before; ``stretches`` has (h, i) sorted.

    Neighbours with one hash are adjacent, so all but the first of each group
    are repeats; their starts in order cover at most STRETCH words each, less
    where the next one starts earlier. O(n log n) for a text of n words.
    """
    return F.transform(
        F.filter(
            F.zip_with(
                F.slice(stretches, F.lit(2), F.size(stretches)),
                F.slice(stretches, F.lit(1), F.greatest(F.size(stretches) - 1, F.lit(0))),
                lambda a, b: F.when(a["h"] == b["h"], a["i"]),
            ),
            lambda i: i.isNotNull(),
        ),
        lambda i: i,
    )


def with_measures(df: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """``keep`` and the measures of every text; see :func:`repetition_report`."""
    kept = df.select(*keep, F.coalesce(F.col(text_col), F.lit("")).alias("__t"))
    worded = kept.withColumn("__w", words(F.col("__t")))
    n = F.size("__w")
    at = F.when(n >= STRETCH, F.sequence(F.lit(1), n - (STRETCH - 1))).otherwise(F.array().cast("array<int>"))
    # the shifted arrays are zipped, so that no element access recomputes the words
    hashed = worded.withColumn("__h", F.transform("__w", lambda w: F.xxhash64(w)))
    shifted = [F.slice("__h", F.lit(k), F.greatest(n - (STRETCH - 1), F.lit(0))) for k in range(1, STRETCH + 1)]
    zipped = F.arrays_zip(*[s.alias(f"s{k}") for k, s in enumerate(shifted)], at.alias("i"))
    sorted_ = hashed.withColumn("__z", zipped).withColumn(
        "__s",
        F.array_sort(
            F.transform(
                "__z",
                lambda z: F.struct(
                    F.xxhash64(*[z[f"s{k}"] for k in range(STRETCH)]).alias("h"), z["i"].alias("i")
                ),
            )
        ),
    )
    starts = sorted_.withColumn("__p", F.array_sort(repeated_words(F.col("__s"))))
    # each start covers up to the next one, at most STRETCH words
    covered = F.aggregate(
        F.zip_with(
            F.slice("__p", F.lit(2), F.size("__p")),
            F.slice("__p", F.lit(1), F.greatest(F.size("__p") - 1, F.lit(0))),
            lambda b, a: F.least(b - a, F.lit(STRETCH)),
        ),
        F.when(F.size("__p") > 0, F.lit(STRETCH)).otherwise(F.lit(0)),
        lambda s, x: s + x,
    )
    lines = F.filter(F.split("__t", "\n"), lambda x: F.trim(x) != "")
    chars = F.greatest(F.length("__t"), F.lit(1))
    lined = starts.withColumn("__l", lines)
    some = F.greatest(n, F.lit(1))
    stop = F.array(*[F.lit(w) for w in STOPWORDS])
    return lined.select(
        *keep,
        n.alias("n_words"),
        covered.alias("repeated_words"),
        (covered / some).alias("repeated_word_share"),
        (F.length(F.regexp_replace("__t", r"(?U)[\p{L}\p{M}\p{N}\s]+", "")) / chars).alias("symbol_ratio"),
        (F.size(F.filter("__w", lambda w: F.array_contains(stop, w))) / some).alias("stopword_ratio"),
        (1 - F.size(F.array_distinct("__l")) / F.greatest(F.size("__l"), F.lit(1))).alias("__dup"),
        F.size("__l").alias("n_lines"),
        (F.aggregate("__w", F.lit(0), lambda s, w: s + F.length(w)) / some).alias("mean_word_length"),
    ).withColumn("duplicate_line_share", F.when(F.col("n_lines") > 0, F.col("__dup")).otherwise(F.lit(0.0))).drop("__dup")


def compile_rules(rules: list[tuple[str, str, float]]) -> Column:
    """The names of the rules that fire, in the order of the table."""
    test = {">=": lambda c, v: c >= v, ">": lambda c, v: c > v, "<": lambda c, v: c < v, "<=": lambda c, v: c <= v}
    fired = [F.when(test[op](F.col(m), F.lit(v)), F.lit(f"{m}{op}{v:g}")) for m, op, v in rules]
    return F.array_compact(F.array(*fired))


def repetition_report(df: DataFrame, id_col: str, text_col: str, *, rules: list[tuple[str, str, float]] = RULES, keep: tuple[str, ...] = ()) -> DataFrame:
    """Measures of every text and the rules that fire.

    Columns: ``id_col``, ``keep``, ``n_words, repeated_words,
    repeated_word_share, symbol_ratio, stopword_ratio, n_lines,
    mean_word_length, duplicate_line_share, fired``. A word counts as repeated
    if it lies in a stretch of :data:`STRETCH` or more words that already stood
    earlier in the text. Null and empty texts have no words and shares of 0.
    One row per input row, repeated rows included; other columns are ignored.
    """
    names = list(dict.fromkeys([id_col, *keep]))
    return with_measures(df, text_col, names).withColumn("fired", compile_rules(rules))


def repeated_rows(df: DataFrame, id_col: str, text_col: str, delivered_col: str, rule: tuple[str, str, float] = RULES[0]) -> DataFrame:
    """``id_col`` of the latest deliveries for which the rule fires; null ids are left out.

    Only ids, times and flags are shuffled.
    """
    report = repetition_report(df, id_col, text_col, rules=[rule], keep=(delivered_col,))
    flagged = report.filter(F.col(id_col).isNotNull()).select(
        F.col(id_col).alias("id"), F.col(delivered_col).alias("t"), (F.size("fired") > 0).cast("int").alias("hit")
    )
    latest = flagged.groupBy("id").agg(F.max(F.struct("t", "hit")).alias("x"))
    return latest.filter("x.hit = 1").select("id")


__all__ = ["RULES", "STRETCH", "compile_rules", "repeated_rows", "repetition_report", "with_measures", "words"]
