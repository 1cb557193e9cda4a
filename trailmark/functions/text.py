"""Column expressions on texts and steps. All are built-in, none calls Python."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that decide results, as they must be; letter case never matters.
EXECUTION = [
    r"run test",
    r"pytest",
    r"apply (?:the )?(?:fix|patch|code fix)",
    r"modify (?:the )?(?:code|implementation)",
    r"add (?:or update )?(?:unit )?tests",
    r"<\w+>",
    r"verify the fix",
]
REASONING = [
    r"locate (?:the )?root cause",
    r"trace (?:the )?(?:call chain|failure)",
    r"explain why",
    r"identify (?:the )?(?:bug|issue|faulty)",
]
PREPARATION = [
    r"^read\b",
    r"^understand\b",
    r"^review the (?:task|issue|bug report)\b",
]
TOOL_TRACE = [
    r"<\w+>",
    r"^diff --git", r"^@@ ", r"^--- a/", r"^\+\+\+ b/",
    r"```",
    r"\bdef \w+",
    r"\w+\([^)]*\)",
    r"\b(?:src|tests?|test)/\S+",
    r"\b\w+\.py\b",
    r"Output:",
    r"\bPASSED\b", r"\bFAILED\b", r"\bpassed\b", r"\bfail(?:ed|ure)?\b",
]
REASONING_TRACE = [
    r"\broot cause\s+(?:is|was|are|were)\b",
    r"\bthe (?:issue|problem|bug)\s+(?:is|was|lies)\b",
    r"\bbecause\b",
    r"\bdue to\b",
    r"\bcaused by\b",
    r"\btherefore\b", r"\bthus\b", r"\bhence\b",
    r"\bleads? to\b", r"\bresults? (?:in|from)\b",
]
INTENTION = [
    r"\b(?:i|we)?\s*(?:will|would|plan(?:ning)?\s+to|intend(?:ing)?\s+to|(?:am|are)\s+going\s+to|need\s+to)\b",
    r"(?:我|我们)?(?:将|会|计划|打算|准备|需要)(?:先|再|去|要)?",
]
SENTENCE_END = "([.!?。！？；;])"
PIECE_BREAK = r"(?U)[，,。；;！!？?\n\s]"


def matches(c: Column, patterns: list[str] | tuple[str, ...], flags: str = "iU") -> Column:
    """Whether one of the patterns is found; none is if there are none."""
    return c.rlike(f"(?{flags})" + "|".join(patterns)) if patterns else F.when(c.isNotNull(), F.lit(False))


def strip(c: Column) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def optional(c: Column) -> Column:
    """Stripped, or null if nothing is left."""
    return F.nullif(strip(c), F.lit(""))


def fold(c: Column) -> Column:
    """Case folded, white space collapsed, stripped."""
    return strip(F.regexp_replace(F.replace(F.lower(c), F.lit("ß"), F.lit("ss")), r"(?U)\s+", " "))


def normalized_steps(steps: Column) -> Column:
    """Steps without blank or null candidates, and without steps that have none left."""
    clean = F.transform(
        F.filter(F.coalesce(steps, F.array().cast("array<array<string>>")), lambda s: s.isNotNull()),
        lambda s: F.filter(F.transform(F.filter(s, lambda c: c.isNotNull()), strip), lambda c: c != ""),
    )
    return F.filter(clean, lambda s: F.size(s) > 0)


def step_label(step: Column) -> Column:
    """The candidates of a step in one string."""
    return F.array_join(step, " | ")


def step_tier(text: Column) -> Column:
    """``observable``, ``reasoning`` or ``proxy``."""
    t = strip(F.coalesce(text, F.lit("")))
    return (
        F.when(t == "", "proxy")
        .when(matches(t, EXECUTION), "observable")
        .when(matches(t, REASONING), "reasoning")
        .when(matches(t, PREPARATION), "proxy")
        .otherwise("reasoning")
    )


def once(value: Column, use) -> Column:
    """``use`` of a value that is computed once, however often it occurs in there."""
    return F.element_at(F.transform(F.array(value), use), 1)


def candidates_tier(step: Column) -> Column:
    """The tier of a step from those of its candidates, each looked at once."""
    bit = lambda t: F.when(t == "observable", 1).when(t == "proxy", 2).otherwise(4)
    seen = F.aggregate(step, F.lit(0), lambda s, c: s.bitwiseOR(once(step_tier(c), bit)))
    return once(seen, lambda s: F.when(s.bitwiseAND(F.lit(1)) > 0, "observable").when(s == 2, "proxy").otherwise("reasoning"))


def sentences(text: Column) -> Column:
    """Stripped, non-empty sentences."""
    cut = F.split(F.regexp_replace(text, SENTENCE_END, "$1\n"), r"\n+")
    return F.filter(F.transform(cut, strip), lambda s: s != "")


def mentions(sentence: Column, step: Column) -> Column:
    """Whether a sentence has a candidate of the step word for word, letter case aside."""
    return F.exists(step, lambda c: F.contains(F.lower(sentence), F.lower(c)))


def intention_fraction(response: Column, steps: Column) -> Column:
    """Share of (normalised) steps that only sentences of intention mention."""
    marked = F.transform(sentences(F.coalesce(response, F.lit(""))), lambda s: F.struct(s.alias("s"), matches(s, INTENTION).alias("i")))
    recited = F.filter(
        steps,
        lambda step: F.exists(marked, lambda m: m["i"] & mentions(m["s"], step)) & ~F.exists(marked, lambda m: ~m["i"] & mentions(m["s"], step)),
    )
    return F.when(F.size(steps) > 0, F.size(recited) / F.size(steps)).otherwise(F.lit(0.0))


def has_trace(response: Column, steps: Column, tools: list[str] = TOOL_TRACE, reasoning: list[str] = REASONING_TRACE) -> Column:
    """Tool evidence in the text, or reasoning in what is left of it without the steps' names."""
    text = F.coalesce(response, F.lit(""))
    rest = F.aggregate(
        F.flatten(steps), text, lambda t, s: F.regexp_replace(t, F.concat(F.lit("(?iu)\\Q"), F.replace(s, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E")), F.lit(" "))
    )
    return F.when(text == "", False).when(matches(text, tools, "imU"), True).otherwise(matches(rest, reasoning))


def split_think(solution: Column) -> Column:
    """``think`` (inside the first pair of tags) and ``answer`` (behind it)."""
    text = F.coalesce(solution, F.lit(""))
    paired = text.rlike(r"(?s)<think>.*?</think>")
    close = F.instr(text, "</think>")
    return F.struct(
        F.when(paired, strip(F.regexp_extract(text, r"(?s)<think>(.*?)</think>", 1))).otherwise("").alias("think"),
        F.when(paired, strip(F.substring(text, close + 8, F.length(text)))).otherwise(strip(text)).alias("answer"),
    )


def long_pieces(text: Column) -> Column:
    """Pieces between punctuation and blanks with more than three characters."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), PIECE_BREAK), lambda p: F.length(p) > 3)


def repetition(pieces: Column) -> Column:
    """``rate`` of repeated pieces and the ``penalty`` (0 or less); ``pieces`` from :func:`long_pieces`."""
    n = F.size(pieces)
    distinct = F.size(F.array_distinct(pieces))
    repeated = n - distinct
    neighbours = F.zip_with(
        F.slice(pieces, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(pieces, F.lit(2), F.greatest(n - 1, F.lit(0))), lambda a, b: (a == b).cast("int")
    )
    same = F.aggregate(neighbours, F.lit(0), lambda s, x: s + x)
    few = F.when(distinct / F.greatest(n, F.lit(1)) < 0.3, 0.5).otherwise(0.0)
    penalty = -(same * 0.3 + F.greatest(repeated - same, F.lit(0)) * 0.1) - few
    return F.struct(
        F.when(n > 1, repeated / F.greatest(n, F.lit(1))).otherwise(0.0).alias("rate"), F.when(n > 1, penalty).otherwise(0.0).alias("penalty")
    )


def lexical_coverage(response: Column, steps: Column) -> Column:
    """Share of (raw) steps of which a candidate occurs in the folded response."""
    text = fold(F.coalesce(response, F.lit("")))
    hit = F.filter(steps, lambda s: F.exists(s, lambda c: (fold(F.coalesce(c, F.lit(""))) != "") & F.contains(text, fold(F.coalesce(c, F.lit(""))))))
    return F.when(F.size(steps) > 0, F.size(hit) / F.size(steps)).otherwise(F.lit(0.0))


def label_share(answer: Column, steps: Column) -> Column:
    """Share of normalised steps whose label is a substring of the answer: scoring without an encoder."""
    hit = F.filter(steps, lambda s: F.contains(answer, step_label(s)))
    return F.when((F.size(steps) > 0) & (answer != ""), F.size(hit) / F.size(steps)).otherwise(F.lit(0.0))


def coerced_label(label: Column) -> Column:
    """0 or 1 from the accepted spellings; null stays null, anything else is an error."""
    text = F.lower(label.cast("string"))
    return (
        F.when(label.isNull(), F.lit(None).cast("int"))
        .when(text.isin("1", "true", "positive", "genuine"), F.lit(1))
        .when(text.isin("0", "false", "negative", "hard_negative"), F.lit(0))
        .otherwise(F.raise_error(F.concat(F.lit("unsupported label: "), text)).cast("int"))
    )


def clamp01(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))
