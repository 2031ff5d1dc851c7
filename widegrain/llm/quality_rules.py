"""Quality rules as a learned decision list, native to Spark SQL from end to end.

Text statistics are built-in expressions inside the scan (no shuffle of text). Labelled
documents are pre-aggregated to a bounded grid of binned statistics; on that grid the
driver grows and prunes threshold conjunctions by sequential covering, and the result is
one ordered conditional expression: the first rule that holds rejects the document.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from widegrain.llm.common import WORD_SPLIT, save

SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Thresholds lie at these quantiles of the good and of the bad documents and half way
#: between two that follow each other: at most 7 for each of six measures, so the grid
#: has at most 8 ** 6 cells for each label and half, whatever the number of documents.
CUTS = (0.02, 0.98)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, as a one-element transform."""
    return F.element_at(F.transform(F.array(value), body), 1)


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), WORD_SPLIT), "")


def repeat_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the same array.

    Windows are compared by a 64-bit hash of their three words. Their (hash, place) pairs
    are sorted, so equal windows stand together; the places found are sorted again and
    each adds the words that its predecessor doesn't cover: n log n for any text.
    """
    window = lambda i: F.struct(F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i"))
    pairs = F.when(F.size(words) > 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - 3, F.lit(0))), window)))

    def covered(sorted_pairs: Column) -> Column:
        twice = F.filter(
            sorted_pairs,
            lambda x, k: F.coalesce(F.get(sorted_pairs, k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(sorted_pairs, k + 1)["h"] == x["h"], F.lit(False)),
        )
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last"))
        step = lambda acc, x: F.struct((acc["n"] + F.least(F.lit(3), x - acc["last"])).alias("n"), x.alias("last"))
        return F.aggregate(places, start, step, lambda acc: acc["n"])

    return F.coalesce(let(pairs, covered), F.lit(0)).cast("long")


def statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id with n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words.

    Words are `[^\\x20\\x09-\\x0D]+`; n_lines counts lines with a word, n_dup_lines those
    equal to an earlier line. A null text counts as empty, with zeros throughout.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    counted = let(
        words_of(F.col(text_col)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeat_words(w).alias("n_repeat_words"),
        ),
    )
    by_line = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    found = docs.select(F.col(id_col).alias("doc_id"), counted.alias("w"), by_line.alias("l"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"))
    return found.select("doc_id", "w.n_words", "w.word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


#: The statistics that rules test, as expressions of the counts.
MEASURES: dict[str, Callable[[], Column]] = {
    "words": lambda: F.col("n_words").cast("double"),
    "chars_per_word": lambda: F.col("word_chars") / F.greatest("n_words", F.lit(1)),
    "symbols_per_word": lambda: F.col("n_symbols") / F.greatest("n_words", F.lit(1)),
    "dup_line_share": lambda: F.col("n_dup_lines") / F.greatest("n_lines", F.lit(1)),
    "repeat_share": lambda: F.col("n_repeat_words") / F.greatest("n_words", F.lit(1)),
    "words_per_line": lambda: F.col("n_words") / F.greatest("n_lines", F.lit(1)),
}


@dataclass(frozen=True)
class Test:
    """`measure` > `cut` if above, else `measure` <= `cut`; `bin` is the cut's number."""

    measure: str
    above: bool
    cut: float
    bin: int

    def column(self) -> Column:
        value = MEASURES[self.measure]()
        return value > self.cut if self.above else value <= self.cut

    def holds(self, cell: dict) -> bool:
        return (cell[self.measure] > self.bin) == self.above

    def __str__(self) -> str:
        return f"{self.measure} {'>' if self.above else '<='} {self.cut:g}"


@dataclass
class DecisionList:
    """Ordered rules; a document is rejected by the first whose tests all hold."""

    rules: list[tuple[Test, ...]] = field(default_factory=list)

    def verdict(self) -> Column:
        """True if the document is kept."""
        out = None
        for tests in self.rules:
            hit = tests[0].column()
            for t in tests[1:]:
                hit = hit & t.column()
            out = F.when(hit, False) if out is None else out.when(hit, False)
        return F.lit(True) if out is None else out.otherwise(True)

    def __str__(self) -> str:
        lines = [f"reject if {' and '.join(map(str, r))}" for r in self.rules]
        return "\n".join([*lines, "keep"])


def learn(stats: DataFrame, labels: DataFrame, min_precision: float = 0.8, min_cover: int = 5, max_rules: int = 12) -> DecisionList:
    """Sequential covering over all labelled documents (quality 1 good, 0 bad).

    Documents that the base rules reject are left out. Labels of null id or quality are
    ignored, and a document labelled twice takes its lower label. Two thirds of the
    documents, by id hash, grow rules and one third prunes them.
    """
    known = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = stats.where(~base_failed()).join(known.withColumnRenamed("doc_id", "label_id"), F.col("doc_id") == F.col("label_id"))
    rows = save(rows.select("doc_id", "quality", *[m().alias(n) for n, m in MEASURES.items()]))
    found = rows.groupBy(F.col("quality") > 0).agg(*[F.percentile_approx(n, list(CUTS)).alias(n) for n in MEASURES]).collect()
    if not found:
        return DecisionList()
    points = {n: sorted(x for r in found for x in r[n]) for n in MEASURES}
    cuts = {n: sorted({*p, *((a + b) / 2 for a, b in zip(p, p[1:]))}) for n, p in points.items()}
    bins = [sum(((F.col(n) > c).cast("int") for c in cuts[n]), F.lit(0)).alias(n) for n in MEASURES]
    half = (F.pmod(F.xxhash64("doc_id"), F.lit(3)) == 0).alias("prune")
    grid = rows.select("quality", half, *bins).groupBy("quality", "prune", *MEASURES).count().collect()
    cells = [r.asDict() for r in grid]
    cells.sort(key=lambda c: tuple(c[k] for k in sorted(c)))
    return cover([c for c in cells if not c["prune"]], [c for c in cells if c["prune"]], cuts, min_precision, min_cover, max_rules)


def _counts(cells: Sequence[dict], tests: Sequence[Test]) -> tuple[int, int]:
    """(bad, good) documents that all tests hold for."""
    bad = good = 0
    for c in cells:
        if all(t.holds(c) for t in tests):
            if c["quality"] == 0:
                bad += c["count"]
            else:
                good += c["count"]
    return bad, good


def cover(grow: list[dict], prune: list[dict], cuts: dict[str, list[float]], min_precision: float, min_cover: int, max_rules: int) -> DecisionList:
    # Of tests with equal gain the first wins, so the ones that cover least come first.
    tests = [Test(n, True, cuts[n][i], i) for n in cuts for i in reversed(range(len(cuts[n])))]
    tests += [Test(n, False, cut, i) for n in cuts for i, cut in enumerate(cuts[n])]
    out = DecisionList()
    while len(out.rules) < max_rules:
        rule = _grow(grow, tests)
        if rule:
            rule = _prune(prune, rule)
        bad, good = _counts([*grow, *prune], rule) if rule else (0, 0)
        if not rule or bad < min_cover or bad < min_precision * (bad + good):
            break
        out.rules.append(rule)
        grow = [c for c in grow if not all(t.holds(c) for t in rule)]
        prune = [c for c in prune if not all(t.holds(c) for t in rule)]
    return out


def _grow(cells: list[dict], tests: list[Test]) -> tuple[Test, ...]:
    """Add the test of greatest information gain until no good document is covered."""
    rule: tuple[Test, ...] = ()
    bad, good = _counts(cells, rule)
    while bad and good:
        best, gain, at = None, 1e-9, (0, 0)
        before = math.log2(bad / (bad + good))
        below = {m: _up_to(cells, m) for m in {t.measure for t in tests}}
        for t in tests:
            b, g = below[t.measure][t.bin]
            if t.above:
                b, g = bad - b, good - g
            if b and b * (math.log2(b / (b + g)) - before) > gain:
                best, gain, at = t, b * (math.log2(b / (b + g)) - before), (b, g)
        if best is None:
            break
        rule, (bad, good) = (*rule, best), at
        cells = [c for c in cells if best.holds(c)]
    return rule


def _up_to(cells: list[dict], measure: str) -> dict[int, tuple[int, int]]:
    """(bad, good) documents whose measure is at or below each cut: one pass for all cuts."""
    counts = [[0, 0] for _ in range(len(CUTS) * 4)]
    for c in cells:
        counts[c[measure]][c["quality"] > 0] += c["count"]
    out, bad, good = {}, 0, 0
    for i, (b, g) in enumerate(counts):
        bad, good = bad + b, good + g
        out[i] = (bad, good)
    return out


def _prune(cells: list[dict], rule: tuple[Test, ...]) -> tuple[Test, ...]:
    """Drop final tests while the pruning documents say so; the shortest best prefix."""
    def worth(r):
        bad, good = _counts(cells, r)
        return (bad - good) / (bad + good) if bad + good else -1.0

    sizes = range(1, len(rule) + 1)
    return rule[: max(sizes, key=lambda n: (worth(rule[:n]), -n))]


def judge(docs: DataFrame, labels: DataFrame, rules: DecisionList | None = None) -> DataFrame:
    """Statistics of every document with base_failed and kept.

    kept is false if the base rules fail, else the decision list's verdict; with no
    usable label the list is empty and keeps all else. Equal rows get equal results, null
    ids are carried along, and other columns are ignored.
    """
    stats = save(statistics(docs))
    found = rules if rules is not None else learn(stats, labels)
    failed = stats.withColumn("base_failed", base_failed())
    return failed.withColumn("kept", ~F.col("base_failed") & found.verdict())


def query(spark, sf_dir: str) -> DataFrame:
    """Contract columns of op9 over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
