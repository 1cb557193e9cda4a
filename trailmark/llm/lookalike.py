"""Problem 2: one consistent form for texts that look alike.

Every character is decomposed, replaced by the prototype of its look-alikes and
decomposed again. Full-width, half-width and mathematical forms, no-break
spaces and joined letters follow from the character database by rule. Letters
of other scripts that are drawn as Latin ones come from the public table of
confusables, as the Unicode library beside Spark has it; a short list says
where that table would mix letters up or is silent. Letter case, digits, raised
digits and accents stay as they are.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.plans.shared import write_shared
from trailmark.plans.sizing import broadcast_if_small

#: Members of one stored form that are joined in one part, about.
SPLIT_ROWS = 100_000

#: Letters of the common scripts drawn alike, by prototype; they go before the public table.
PROTOTYPES = {
    "A": "АΑᎪ", "B": "ВΒᏴ", "C": "СϹᏟ", "D": "Ꭰ", "E": "ЕΕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "НΗᎻ",
    "I": "ІΙӀ", "J": "ЈͿᎫ", "K": "КΚᏦ", "L": "ԼᏞ", "M": "МΜᎷ", "N": "Ν", "O": "ОΟՕ", "P": "РΡᏢ",
    "Q": "Ԛ", "R": "ᎡᏒ", "S": "ЅՏᏚ", "T": "ТΤᎢ", "V": "ѴᏙ", "W": "ԜᎳ", "X": "ХΧ", "Y": "УΥҮ", "Z": "ΖᏃ",
    "a": "аαɑ", "c": "сϲ", "d": "ԁ", "e": "еҽ", "g": "ɡց", "h": "һհ", "i": "іιı", "l": "ӏ", "j": "јϳȷյ", "n": "ո",
    "o": "оοօ", "p": "рρ", "q": "ԛզ", "s": "ѕ", "u": "սυ", "v": "ѵν", "w": "ԝ", "x": "х", "y": "уγү",
    "ß": "β", "μ": "µ",
}
#: Joined letters that the character database does not take apart.
JOINED = {"œ": "oe", "Œ": "OE", "æ": "ae", "Æ": "AE", "ꜳ": "aa", "Ꜳ": "AA"}
_TO = {ord(x): p for p, all_x in PROTOTYPES.items() for x in all_x} | {ord(x): y for x, y in JOINED.items()}
_FORMS = ("<wide>", "<narrow>", "<font>", "<noBreak>")
#: Ranges of characters that show nothing though their category is not "format".
_INVISIBLE = [
    (0x034F, 0x034F), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F), (0x3164, 0x3164),
    (0xFE00, 0xFE0F), (0xFFA0, 0xFFA0), (0xE0100, 0xE01EF),
]


def _decompose(ch: str) -> str:
    """Canonical parts of a character, and of forms that only differ in width, font or joining."""
    out = ""
    for c in unicodedata.normalize("NFD", ch):
        tag, *parts = unicodedata.decomposition(c).split() or [""]
        if tag.startswith("<"):
            seen = "".join(chr(int(p, 16)) for p in parts)
            joined = tag == "<compat>" and len(seen) > 1 and all(x.isalpha() for x in seen)
            roman = tag == "<compat>" and "ROMAN NUMERAL" in unicodedata.name(c, "")
            if tag in _FORMS or joined or roman:
                out += "".join(_decompose(x) for x in seen)
                continue
        out += c
    return out


#: Letters of no script below are asked for: ideographs and syllables have no Latin look-alikes.
_ASKED = [(0x80, 0x3400), (0xA000, 0xAC00), (0xD7B0, 0xD800), (0xF900, 0x20000)]
_public: dict[str, dict[int, str]] = {}


def confusables(spark: SparkSession) -> dict[int, str]:
    """Letters that the public confusables give the form of one Latin letter, by code point; read once per application.

    The table has one class for l, I and 1: of it capital letters, and those of
    the script that has capitals only, become I, the others stay. What looks
    like two letters (rn) is the one that is drawn so (m).
    """
    app = spark.sparkContext.applicationId
    if app not in _public:
        letters = [chr(c) for lo, hi in _ASKED for c in range(lo, hi) if unicodedata.category(chr(c))[0] == "L"]
        checker = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker.Builder().build()
        forms = dict(zip(letters, checker.getSkeleton("\n".join(letters)).split("\n"), strict=True))
        capital = lambda c: unicodedata.category(c) == "Lu" or unicodedata.name(c, "").startswith("LISU")
        chosen = {c: "m" if p == "rn" else p for c, p in forms.items()}
        chosen = {c: "I" if p == "l" and capital(c) else p for c, p in chosen.items() if p != "l" or capital(c)}
        _public[app] = {ord(c): p for c, p in chosen.items() if len(p) == 1 and p.isascii() and p.isalpha()}
    return _public[app]


def prototype(ch: str, more: dict[int, str]) -> str:
    """What a single character becomes; ``more`` is :func:`confusables`."""
    if unicodedata.category(ch) == "Cf" or any(a <= ord(ch) <= b for a, b in _INVISIBLE):
        return ""
    if ch in "\t\x0b\x0c" or unicodedata.category(ch) == "Zs":
        return " "
    if ord(ch) in (0x85, 0x2028, 0x2029):
        return "\n"
    return "".join(_TO.get(ord(c)) or more.get(ord(c), c) for c in _decompose(ch))


class Table(dict):
    """Characters to prototypes, filled as they are met."""

    def __init__(self, more: dict[int, str]) -> None:
        self.more = more

    def __missing__(self, code: int) -> str:
        value = self[code] = prototype(chr(code), self.more)
        return value


_TABLE = Table({})


def skeleton(text: str, table: Table = _TABLE) -> str:
    """The consistent form: equal for texts that read the same. Without a table of one's own the common scripts are covered."""
    if text.isascii():
        return text.translate({9: " ", 11: " ", 12: " "}).replace("\r\n", "\n") if re.search("[\t\x0b\x0c\r]", text) else text
    return unicodedata.normalize("NFD", text.translate(table)).replace("\r\n", "\n")


#: A text with a letter or digit, to be matched by Spark.
WORDLY = r"[\p{L}\p{N}]"


def _digest(text: str) -> str:
    return xxhash.xxh3_128_hexdigest(text.encode("utf-8", "surrogatepass"))


def _mapped(df: DataFrame, columns: list[str], schema: T.StructType, forms: bool) -> DataFrame:
    """Append to the columns the skeleton of the last one (or the digests of both forms)."""
    width, more = len(columns), confusables(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table(more)
        for batch in batches:
            texts = batch.column(width - 1).to_pylist()
            made = [None if t is None else skeleton(t, table) for t in texts]
            head = [batch.column(i) for i in range(width - 1)]
            if forms:
                yield pa.RecordBatch.from_arrays([*head, batch.column(width - 1), pa.array(made, pa.string())], names=schema.names)
                continue
            digests = [pa.array([None if x is None else _digest(x) for x in own], pa.string()) for own in (made, texts)]
            yield pa.RecordBatch.from_arrays([*head, *digests], names=schema.names)

    return df.select(*columns).mapInArrow(run, schema)


def normalize_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id_col``, the stored ``text_col`` and its consistent form ``skeleton``.

    A null text has a null form, an empty one an empty form. One output row per
    input row; other columns are ignored.
    """
    kind = df.schema[id_col].dataType
    schema = T.StructType([T.StructField("__id", kind), T.StructField("__text", T.StringType()), T.StructField("skeleton", T.StringType())])
    made = _mapped(df.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), ["__id", "__text"], schema, True)
    return made.withColumnsRenamed({"__id": id_col, "__text": text_col})


def steps_text(steps: Column) -> Column:
    """Nested steps as one text that keeps their structure; null for null or empty lists."""
    inner = F.transform(steps, lambda s: F.coalesce(F.array_join(s, "\x01", "\x03"), F.lit("\x04")))
    return F.when(F.size(steps) > 0, F.array_join(inner, "\x02"))


def lookalike_classes(texts: DataFrame) -> DataFrame:
    """Membership of the classes of equal reading that hold different stored forms.

    ``texts`` has ``field, id, scope, delivered, text``; two texts are compared
    only within one ``field`` and ``scope``. The latest delivery of an ``id``
    counts. Returns ``field, scope, skeleton, stored, id`` (digests of 128 bits)
    for the classes with at least two stored forms. Null ids and null texts
    belong to no class.

    Only ids and digests are shuffled. Classes are found with a combining
    aggregate, so a text that a third of the rows share costs a row per task.
    """
    columns = ["field", "id", "scope", "delivered", "text"]
    schema = T.StructType(
        [T.StructField("field", T.StringType()), T.StructField("id", T.StringType()), T.StructField("scope", T.StringType()),
         T.StructField("delivered", T.TimestampNTZType() if dict(texts.dtypes)["delivered"] == "timestamp_ntz" else T.TimestampType()),
         T.StructField("skeleton", T.StringType()), T.StructField("stored", T.StringType())]
    )
    digests = _mapped(texts.filter(F.col("id").isNotNull()), columns, schema, False)
    latest = (
        digests.groupBy("field", "id")
        .agg(F.max(F.struct("delivered", "scope", "skeleton", "stored")).alias("x"))
        .select("field", "id", "x.scope", "x.skeleton", "x.stored")
        .filter("skeleton is not null")
    )
    group = ["field", "scope", "skeleton"]
    mixed = latest.groupBy(*group).agg(F.min("stored").alias("lo"), F.max("stored").alias("hi")).filter("lo < hi")
    mixed = mixed.select(F.col("field").alias("f"), F.col("scope").alias("s"), F.col("skeleton").alias("k"))
    same = (F.col("field") == F.col("f")) & F.col("scope").eqNullSafe(F.col("s")) & (F.col("skeleton") == F.col("k"))
    return latest.join(mixed, same, "left_semi").select(*group, "stored", "id")


def lookalike_pairs(members: DataFrame, *, rows: int = SPLIT_ROWS) -> DataFrame:
    """Pairs ``field, id_a, id_b`` (id_a < id_b) of different stored forms of one class.

    ``members`` is the result of :func:`lookalike_classes`. The forms of a class
    are paired first and their members joined to that, so equal texts are never
    compared with each other; the rows are as many as the asked pairs. A form
    with more than ``rows`` members is joined in parts of about so many.
    """
    own = write_shared(members.select("field", "scope", "skeleton", "stored", "id"), "classes")
    form = own.groupBy("field", "scope", "skeleton", "stored").agg(F.count(F.lit(1)).alias("n"))
    form = form.select("field", "scope", "skeleton", "stored", (1 + F.floor(F.col("n") / rows)).cast("int").alias("parts"))
    form = write_shared(form, "forms")
    a = form.select("field", "scope", "skeleton", F.col("stored").alias("st_a"), F.col("parts").alias("parts_a"))
    b = form.select(*[F.col(c).alias(f"{c}_b") for c in ("field", "scope", "skeleton")], F.col("stored").alias("st_b"), F.col("parts").alias("parts_b"))
    same = (F.col("field") == F.col("field_b")) & F.col("scope").eqNullSafe(F.col("scope_b")) & (F.col("skeleton") == F.col("skeleton_b"))
    forms = a.join(b, same & (F.col("st_a") < F.col("st_b"))).select("field", "scope", "st_a", "parts_a", "st_b", "parts_b")
    # forms in parts are at most the rows by ``rows``
    many = form.filter("parts > 1").select(*[F.col(c).alias(f"{c}_m") for c in ("field", "scope", "stored")], "parts")
    keyed = (F.col("field") == F.col("field_m")) & F.col("scope").eqNullSafe(F.col("scope_m")) & (F.col("stored") == F.col("stored_m"))
    part = F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1)))
    placed = own.join(broadcast_if_small(many, 1_000_000), keyed, "left").select("field", "scope", "stored", "id", part.alias("part"))

    def side(left: DataFrame, end: str) -> DataFrame:
        right = placed.select(*[F.col(c).alias(f"{c}_{end}") for c in ("field", "scope", "stored", "part", "id")])
        spread = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col(f"parts_{end}") - 1)))
        on = (F.col("field") == F.col(f"field_{end}")) & F.col("scope").eqNullSafe(F.col(f"scope_{end}")) & (F.col(f"st_{end}") == F.col(f"stored_{end}"))
        return spread.join(right, on & (F.col("part") == F.col(f"part_{end}"))).drop("part", *[f"{c}_{end}" for c in ("field", "scope", "stored", "part")])

    joined = side(side(forms, "a"), "b")
    return joined.select("field", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b"))
