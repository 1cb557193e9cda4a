"""Problem 8: the subject areas a document deals with, by class-association rules.

1. A document becomes a transaction: the words of its message, of its paths and
   of its diff lines, identifiers split into words.
2. Rules "words -> subject" are mined by parallel frequent-pattern growth from a
   bounded sample of rated documents: words are counted by subject in parallel;
   a frequent word that is confident alone is a rule, one that only leans to a
   subject is an item. Transactions of items are sent to groups of items, each
   group grows the patterns of up to MAX_WORDS words that end in it from a prefix
   tree with counts by subject. A rule is dropped if a shorter one within it is
   as confident.
3. These rules rate all documents they tell a clear subject of, and rules are
   mined from the whole corpus so rated, in the same way. Words that several
   subjects share lose their confidence here, rare and foreign ones gain it.
   A subject with few ratings starts from the words of its description.
4. A document deals with a subject if the evidence of its matching rules reaches
   a threshold calibrated on ratings that no rule was mined from, and some of it
   lies in paths or diff lines. Evidence is the sum over the different matched
   words of the best confidence of a rule with that word, in units of the
   confidence that a rule of the subject needs.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trailmark.plans.shared import write_shared

#: Rated documents from which rules are mined at most, and one in how many of them is kept for the calibration.
MAX_RATED, HELD_OUT = 20_000, 10
#: Patterns that a task counts before it hands their counts on.
HELD = 500_000
#: Words in a rule at most, items whose patterns one group grows, and transactions of a group in one task at most.
MAX_WORDS, GROUP_ITEMS, GROUP_ROWS = 3, 16, 1_000_000
#: Least confidence of a mined rule, and least support in documents and as a share of them.
CONFIDENCE, SUPPORT, SUPPORT_SHARE = 0.6, 2, 0.01
#: What a rule from ratings needs more of it for each further word, as there are more such patterns to be wrong about.
LONGER = 0.15
#: Documents of the subjects' shares that are thought added to those of a longer pattern, so that a few agreeing ones are no rule.
PRIOR = 2
#: Least confidence and support share of a rule mined from the corpus, and rounds of mining.
CORPUS_CONFIDENCE, CORPUS_SUPPORT, CORPUS_SHARE, ROUNDS = 0.75, 3, 0.0002, 2
#: The same for a subject known by few words only, and its least confidence against its share of documents.
WEAK_CONFIDENCE, WEAK_LIFT = 0.35, 5
#: What a word needs to be an item of longer patterns: share of its documents in one subject, and that against the subject's share of all.
ITEM_CONFIDENCE, ITEM_LIFT = 0.3, 2.0
#: A subject with fewer mined rules than this also starts from its description.
FEW_RULES = 8
#: More rules, or subjects, than there can be; beyond them the fit refuses.
MAX_RULES, MAX_SUBJECTS = 200_000, 1_000
#: Thresholds of evidence among which the calibration chooses.
THRESHOLDS = [1.5, 2.0, 2.5, 3.0, 3.5, 4.0]
#: The rating that says "no subject".
NO_SUBJECT = "none"

_WORD = re.compile(r"[^\W\d_]{3,}")
_CAMEL = re.compile(r"(?<=[a-zß-ÿ])(?=[A-Z])")
_HEADER = re.compile(r"(?:From [0-9a-f]{7,} |From:|Author:|AuthorDate:|Commit:|CommitDate:|Date:|commit [0-9a-f]{7,}|Signed-off-by:|Co-authored-by:|Merge: )")
_PERSON_LINE = re.compile(r"\S+ \d{4}-\d\d-\d\d \d\d:\d\d:\d\d\s*\Z")
_SKIP = ("--- ", "+++ ", "index ", "new file", "deleted file", "similarity", "rename ", "Binary ", "GIT binary", "old mode", "new mode")
_SUBJECT = re.compile(r"Subject: (?:\[PATCH[^\]]*\] ?)?")


def _words(text: str) -> set[str]:
    return set(_WORD.findall(_CAMEL.sub(" ", text).lower()))


def transaction(text: str) -> tuple[set[str], set[str]]:
    """The words of a document's message, and those of its paths and diff lines."""
    message, code, in_diff = [], [], False
    for line in text.replace("\r", "").split("\n"):
        if line.startswith("diff --git "):
            in_diff = True
            code.append(line.rpartition(" b/")[2])
        elif in_diff:
            if line.startswith("@@"):
                code.append(line.rpartition("@@")[2])
            elif not line.startswith(_SKIP):
                code.append(line)
        elif not _HEADER.match(line) and not _PERSON_LINE.match(line):
            message.append(_SUBJECT.sub("", line) if line.startswith("Subject:") else line)
    return _words("\n".join(message)), _words("\n".join(code))


def _transactions(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, message, code``: the words, separated by blanks, written once."""
    ready = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter("doc_id is not null and text is not null")
    schema = T.StructType([ready.schema["doc_id"], T.StructField("message", T.StringType()), T.StructField("code", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [transaction(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([" ".join(m) for m, _ in both], pa.string()), pa.array([" ".join(c) for _, c in both], pa.string())],
                names=schema.names,
            )

    return write_shared(ready.mapInArrow(run, schema), "words")


def sample_ratings(ratings: DataFrame) -> DataFrame:
    """``doc_id, subjects`` of at most MAX_RATED rated documents, in an order fixed by the id's hash.

    A document's subjects are all that some annotator named; ``none`` is dropped
    where another subject was named too.
    """
    named = ratings.filter("doc_id is not null and subject is not null").groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    return named.orderBy(F.xxhash64("doc_id"), "doc_id").limit(MAX_RATED)


def _rated(words: DataFrame, ratings: DataFrame) -> DataFrame:
    """``message, code, subjects, held`` of the sample, written once; ``held`` rows are for the calibration."""
    subjects = F.when(F.size("subjects") == 1, F.col("subjects")).otherwise(F.array_remove("subjects", NO_SUBJECT))
    held = F.pmod(F.xxhash64(F.lit("held"), "doc_id"), F.lit(HELD_OUT)) == 0
    return write_shared(words.join(F.broadcast(sample_ratings(ratings)), "doc_id").select("message", "code", subjects.alias("subjects"), held.alias("held")), "rated")


Rules = dict[frozenset[str], tuple[str, float]]
#: The subject a transaction counts for, of its message's words, its code's words and its rated subjects; None if it is not clear.
Rater = Callable[[set[str], set[str], list[str] | None], str | None]


def single(message: set[str], code: set[str], subjects: list[str] | None) -> str | None:
    """The rated subject of a document of one; of two, one would lend its words to the other."""
    return subjects[0] if subjects and len(subjects) == 1 else None


class PrefixTree:
    """Transactions by their common beginnings, with counts by subject at each node."""

    def __init__(self) -> None:
        self.root: dict = {}
        self.nodes: dict[int, list[tuple[tuple[int, ...], Counter]]] = defaultdict(list)

    def insert(self, items: tuple[int, ...], counts: Counter) -> None:
        level = self.root
        for k, item in enumerate(items):
            if item not in level:
                level[item] = ({}, Counter())
                self.nodes[item].append((items[:k], level[item][1]))
            level[item][1].update(counts)
            level = level[item][0]

    def grow(self, ends: Iterable[int], longest: int, least: int) -> Iterator[tuple[tuple[int, ...], Counter]]:
        """Patterns of up to ``longest`` items that end in one of ``ends`` and occur ``least`` times, with their counts."""
        for end in ends:
            total: Counter = Counter()
            for _, counts in self.nodes.get(end, ()):
                total.update(counts)
            if sum(total.values()) < max(1, least):
                continue
            yield (end,), total
            if longest > 1:
                conditional = PrefixTree()
                for before, counts in self.nodes[end]:
                    conditional.insert(before, counts)
                for pattern, counts in conditional.grow(list(conditional.nodes), longest - 1, least):
                    yield (*pattern, end), counts


def _count_rows(counts: Counter, names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*counts, strict=True)) or [()] * (len(names) - 1)
    return pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in columns), pa.array(list(counts.values()), pa.int64())], names=names)


def _counted(table: DataFrame, keys: list[str], of: Callable[[set[str], set[str], str], Iterable[tuple[str, ...]]], rater: Rater) -> DataFrame:
    """``keys, n``: how often ``of`` (message, code, subject) gives each key, over the transactions with a clear subject."""
    schema = T.StructType([*(T.StructField(k, T.StringType()) for k in keys), T.StructField("n", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in batches:
            for m, c, own in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                message, code = set(m.split()), set(c.split())
                subject = rater(message, code, own)
                if subject is not None:
                    counts.update(of(message, code, subject))
            if len(counts) >= HELD:
                yield _count_rows(counts, schema.names)
                counts.clear()
        yield _count_rows(counts, schema.names)

    own = F.col("subjects") if "subjects" in table.columns else F.lit(None).cast("array<string>").alias("subjects")
    return table.select("message", "code", own).mapInArrow(run, schema).groupBy(*keys).agg(F.sum("n").alias("n"))


def _collected(df: DataFrame) -> list:
    rows = df.limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules or items")
    return rows


def mine_rules(table: DataFrame, rater: Rater, enough: Callable[[str, float, float, int], bool], support: Callable[[int], float], *, longest: int = MAX_WORDS) -> Rules:
    """Rules {words} -> (subject, confidence) of up to ``longest`` words, by parallel frequent-pattern growth.

    ``table`` has ``message, code`` and, if the rater asks for them, ``subjects``.
    ``enough(subject, confidence, share, words)`` says whether a rule of so many
    words holds for a subject of that share of the documents; ``support(n)`` is the least support
    in ``n`` documents.
    """
    spark = table.sparkSession
    # 1. words by subject; the blank word counts the documents
    words = _counted(table, ["word", "subject"], lambda m, c, s: ((w, s) for w in ("", *(m | c))), rater)
    per = words.groupBy("word").agg(F.sum("n").alias("total"), F.max(F.struct("n", "subject")).alias("top"), F.collect_list(F.struct("subject", "n")).alias("all"))
    per = write_shared(per, "items")  # as many subjects in a row as there are
    totals = {x["subject"]: x["n"] for r in per.filter("word = ''").collect() for x in r["all"]}
    documents = sum(totals.values())
    share = {s: n / max(1, documents) for s, n in totals.items()}
    least = support(documents)
    known = _collected(per.filter((F.col("word") != "") & (F.col("total") >= least) & (F.col("top.n") >= ITEM_CONFIDENCE * F.col("total"))).select("word", "total", "top.n", "top.subject"))
    rules: Rules = {}
    items: list[tuple[int, str]] = []
    for r in known:
        confidence = r["n"] / r["total"]
        if r["n"] >= least and enough(r["subject"], confidence, share[r["subject"]], 1):
            rules[frozenset([r["word"]])] = (r["subject"], confidence)
        elif confidence >= ITEM_LIFT * share[r["subject"]]:
            items.append((-r["total"], r["word"]))
    if longest < 2 or len(items) < 2:
        return rules
    # 2. the frequent words in order, the most frequent first, and their groups
    order = [w for _, w in sorted(items)]
    rank = spark.sparkContext.broadcast({w: i for i, w in enumerate(order)})

    def conditional(message: set[str], code: set[str], subject: str) -> Iterator[tuple[str, ...]]:
        """For each group the transaction up to its last item of that group."""
        path = sorted(rank.value[w] for w in (message | code) & rank.value.keys())
        seen: set[int] = set()
        for k in range(len(path) - 1, 0, -1):
            group = path[k] // GROUP_ITEMS
            if group not in seen:
                seen.add(group)
                yield str(group), " ".join(map(str, path[: k + 1])), subject

    # 3. patterns by group; a group of many transactions is grown in slices, whose counts add up
    slices = 1 + documents // GROUP_ROWS
    sliced = _counted(table, ["group", "path", "subject"], conditional, rater).withColumn("slice", F.pmod(F.xxhash64("path"), F.lit(slices)))
    schema = T.StructType([T.StructField("pattern", T.StringType()), T.StructField("subject", T.StringType()), T.StructField("n", T.LongType())])

    def grown(group: pa.Table) -> pa.Table:
        tree, found = PrefixTree(), Counter()
        own = int(group.column("group")[0].as_py())
        for path, subject, n in zip(*(group.column(c).to_pylist() for c in ("path", "subject", "n")), strict=True):
            tree.insert(tuple(map(int, path.split())), Counter({subject: n}))
        for pattern, counts in tree.grow(range(own * GROUP_ITEMS, (own + 1) * GROUP_ITEMS), longest, least if slices == 1 else 1):
            if len(pattern) > 1:
                for subject, n in counts.items():
                    found[" ".join(map(str, pattern)), subject] += n
        return pa.Table.from_batches([_count_rows(found, schema.names)])

    patterns = sliced.groupBy("group", "slice").applyInArrow(grown, schema).groupBy("pattern", "subject").agg(F.sum("n").alias("n"))
    top = patterns.groupBy("pattern").agg(F.sum("n").alias("total"), F.max(F.struct("n", "subject")).alias("top"))
    good = top.filter((F.col("top.n") >= least) & (F.col("top.n") >= ITEM_CONFIDENCE * F.col("total"))).select("pattern", "total", "top.n", "top.subject")
    for r in sorted(_collected(good), key=lambda r: (r["pattern"].count(" "), r["pattern"])):
        confidence, pattern = r["n"] / r["total"], frozenset(order[int(i)] for i in r["pattern"].split())
        careful = (r["n"] + PRIOR * share[r["subject"]]) / (r["total"] + PRIOR)
        if enough(r["subject"], careful, share[r["subject"]], len(pattern)):
            rules[pattern] = (r["subject"], confidence)
    return pruned(rules)


def pruned(rules: Rules) -> Rules:
    """The rules without those that have a shorter rule, of at least their confidence, within them."""
    kept: Rules = {}
    for words in sorted(rules, key=len):
        within = (kept.get(frozenset(part)) for k in range(1, len(words)) for part in combinations(sorted(words), k))
        if all(r is None or r[1] < rules[words][1] for r in within):
            kept[words] = rules[words]
    return kept


class Matcher:
    """Rules by their words."""

    def __init__(self, rules: Rules, weak: frozenset[str] = frozenset()) -> None:
        self.weak = weak  # subjects of which a single word counts as clear
        needed = lambda s: WEAK_CONFIDENCE if s in weak else CORPUS_CONFIDENCE
        self.one = {next(iter(a)): (s, c / needed(s)) for a, (s, c) in rules.items() if len(a) == 1}
        self.more: dict[str, list[tuple[frozenset[str], str, float]]] = defaultdict(list)
        for a, (s, c) in rules.items():
            if len(a) > 1:
                self.more[min(a)].append((a, s, c / needed(s)))

    def evidence(self, message: set[str], code: set[str]) -> dict[str, tuple[float, int, int]]:
        """For each subject its evidence, the different matched words, and how many of them lie in the code."""
        hit: dict[str, dict[str, float]] = {}
        every = message | code
        for w in self.one.keys() & every:
            s, c = self.one[w]
            hit.setdefault(s, {})[w] = c
        for first in self.more.keys() & every:
            for words, s, c in self.more[first]:
                if words <= every:
                    own = hit.setdefault(s, {})
                    for w in words:
                        own[w] = max(c, own.get(w, 0.0))
        return {s: (sum(words.values()), len(words), len(words.keys() & code)) for s, words in hit.items() if s != NO_SUBJECT}

    def clear(self, message: set[str], code: set[str], subjects: list[str] | None) -> str | None:
        """The one subject that a transaction clearly tells; a second one would lend its words to the first."""
        found = sorted(((n, k, s) for s, (_, n, k) in self.evidence(message, code).items()), reverse=True)
        if not found or not found[0][1] or (len(found) > 1 and found[1][0] >= min(2, found[0][0])):
            return None
        return found[0][2] if found[0][0] >= 2 or found[0][2] in self.weak else None


def seed_rules(areas: list[tuple[str, str]], rules: Rules) -> tuple[Rules, frozenset[str]]:
    """The rules and, for subjects with few of them, one for each word of the description."""
    many = Counter(s for s, _ in rules.values())
    weak = frozenset(s for s, _ in areas if s and s != NO_SUBJECT and many[s] < FEW_RULES)
    named: dict[str, set[str]] = defaultdict(set)
    for s, covers in areas:
        for w in _words((covers or "").partition("(")[0]):
            for form in {w, w[:-1] if w.endswith("s") else w, w[:-3] + "y" if w.endswith("ies") else w}:
                named[form].add(s)
    seeds = {frozenset([w]): (next(iter(s)), 0.5) for w, s in named.items() if len(s) == 1 and s <= weak}
    return seeds | rules, weak


def calibrate(matcher: Matcher, rated: DataFrame) -> float:
    """The evidence (of THRESHOLDS) that separates rated transactions (``message, code, subjects``) best.

    It is the least whose F1 is within a standard error of the best one, so few ratings don't ask for much evidence by chance.
    """
    shared = rated.sparkSession.sparkContext.broadcast(matcher)
    schema = T.StructType([T.StructField("least", T.DoubleType()), *(T.StructField(c, T.LongType()) for c in ("right", "wrong", "missed"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shared.value
        tally = {least: [0, 0, 0] for least in THRESHOLDS}
        for batch in batches:
            for m, c, subjects in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                found, true = matcher.evidence(set(m.split()), set(c.split())), set(subjects) - {NO_SUBJECT}
                for least, row in tally.items():
                    said = {s for s, (e, _, k) in found.items() if e >= least and k}
                    for i, x in enumerate((said & true, said - true, true - said)):
                        row[i] += len(x)
        columns = [pa.array(tally, pa.float64()), *(pa.array([row[i] for row in tally.values()], pa.int64()) for i in range(3))]
        yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    sums = rated.select("message", "code", "subjects").mapInArrow(run, schema).groupBy("least").agg(*(F.sum(c).alias(c) for c in schema.names[1:]))
    scores = [(least, 2 * right / max(1, 2 * right + wrong + missed), right + wrong + missed) for least, right, wrong, missed in sorted(map(tuple, sums.collect()))]
    if not scores:
        return THRESHOLDS[0]
    best, n = max((f1, n) for _, f1, n in scores)
    return next(least for least, f1, _ in scores if f1 >= best - (best * (1 - best) / max(1, n)) ** 0.5)


def fit_rules(words: DataFrame, rated: DataFrame, areas: list[tuple[str, str]]) -> Matcher:
    """Rules mined from the ratings, then from the corpus that they rate."""
    mined = rated.filter("not held")
    rules = mine_rules(
        mined, single, lambda s, confidence, share, n: confidence >= CONFIDENCE + LONGER * (n - 1), lambda n: max(SUPPORT, SUPPORT_SHARE * n)
    )
    for _ in range(ROUNDS):
        rules, weak = seed_rules(areas, rules)
        matcher = words.sparkSession.sparkContext.broadcast(Matcher(rules, weak))

        def enough(subject: str, confidence: float, share: float, n: int, weak: frozenset[str] = weak) -> bool:
            # the confidence must also exceed what the subject's share of the corpus explains
            if subject in weak and n == 1:  # documents of a weak subject and another still count for the other one
                return confidence >= max(WEAK_CONFIDENCE, WEAK_LIFT * share)
            return confidence >= min(0.95, CORPUS_CONFIDENCE + 0.5 * share)

        def clear(message: set[str], code: set[str], subjects: list[str] | None, matcher=matcher) -> str | None:
            return matcher.value.clear(message, code, subjects)

        rules = mine_rules(words, clear, enough, lambda n: max(CORPUS_SUPPORT, CORPUS_SHARE * n)) or rules
    return Matcher(rules, weak)


def document_subjects(docs: DataFrame, ratings: DataFrame, areas: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, subject, evidence, words, in_code``: every subject each document deals with.

    ``ratings`` has ``doc_id, subject``; the documents it names are the sample
    of which at most MAX_RATED are used; ``areas`` has ``subject, covers``, at
    most MAX_SUBJECTS of them, or the fit refuses. Null or empty texts and null
    ids give no row; without ratings only the descriptions are left to learn
    from. Repeated documents give their rows once per id and subject. ``words``
    is the number of different matched words, ``in_code`` how many of them lie
    in paths or diff lines.
    """
    spark = docs.sparkSession
    described = [(r["subject"], r["covers"]) for r in areas.select("subject", "covers").limit(MAX_SUBJECTS + 1).collect()]
    if len(described) > MAX_SUBJECTS:
        raise ValueError(f"more than {MAX_SUBJECTS} subjects")
    words = _transactions(docs, id_col, text_col)
    rated = _rated(words, ratings)
    matcher = fit_rules(words, rated, described)
    least = calibrate(matcher, rated.filter("held"))
    shared = spark.sparkContext.broadcast(matcher)
    schema = T.StructType(
        [words.schema["doc_id"], T.StructField("subject", T.StringType()), T.StructField("evidence", T.DoubleType()), T.StructField("words", T.IntegerType()),
         T.StructField("in_code", T.IntegerType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = shared.value
        for batch in batches:
            rows = []
            for i, (m, c) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                rows += [(i, s, e, n, k) for s, (e, n, k) in matcher.evidence(set(m.split()), set(c.split())).items() if e >= least and k]
            at, *columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=schema.names
            )

    found = words.mapInArrow(run, schema)
    return found.groupBy("doc_id", "subject").agg(*(F.max(c).alias(c) for c in ("evidence", "words", "in_code")))


def corpus_composition(found: DataFrame, docs: DataFrame, *, id_col: str = "doc_id") -> DataFrame:
    """``subject, n_docs, share``: documents per subject and their share of all; ``none`` for those without one."""
    total = docs.select(F.countDistinct(id_col).alias("total"))
    per = found.groupBy("subject").agg(F.countDistinct("doc_id").alias("n_docs"))
    some = found.agg(F.countDistinct("doc_id").alias("some"))
    rest = total.join(F.broadcast(some)).select(F.lit(NO_SUBJECT).alias("subject"), (F.col("total") - F.col("some")).alias("n_docs"))
    return per.unionByName(rest).join(F.broadcast(total)).select("subject", "n_docs", (F.col("n_docs") / F.greatest("total", F.lit(1))).alias("share"))
