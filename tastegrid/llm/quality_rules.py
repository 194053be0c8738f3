"""Quality rules: text statistics, a fixed base filter, and a decision list learned from labelled documents.

The list is grown by sequential covering. Each rule is a conjunction of thresholds: conditions are added by information
gain on two thirds of the labelled rows and pruned on the other third; rows that a rule covers are set aside for the next.
Every count comes from an aggregate over all labelled rows, so learning needs no sample. The list is emitted as one ordered
``CASE WHEN`` over the statistics.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from math import log2

from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.functions.hashing import md5_int
from tastegrid.llm.registry import GAP
from tastegrid.session import materialise

SYMBOLS = "#*$%&|<>"
BLANKS = " \t\n\x0b\f\r"
WINDOW = 3
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

#: What the rules may look at, in terms of the columns of :func:`statistics`.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "mean_word_chars": "word_chars / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
}


def _bound(value: Column, body) -> Column:
    """``body`` of ``value``, which is computed once although a lambda in ``body`` reads it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def repeat_words(words: Column) -> Column:
    """Words that lie in a three-word window found twice or more: windows sorted by hash show their repeats side by side,
    and the places of the repeated ones, in order, add what each covers beyond the next one's start."""

    def places(sorted_windows: Column) -> Column:
        same = lambda i, j: F.get(sorted_windows, i)["h"] == F.get(sorted_windows, j)["h"]
        flagged = F.filter(
            F.transform(sorted_windows, lambda w, i: F.struct(w["at"].alias("at"), (F.coalesce(same(i, i - 1), F.lit(False)) | F.coalesce(same(i, i + 1), F.lit(False))).alias("twice"))),
            lambda w: w["twice"],
        )
        return F.sort_array(F.transform(flagged, lambda w: w["at"]))

    def covered(at: Column) -> Column:
        gaps = F.transform(at, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(at, i + 1) - p, F.lit(WINDOW))))
        return F.aggregate(gaps, F.lit(0), lambda a, g: a + g)

    def of(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.struct(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)).alias("h"), i.alias("at")))
        return _bound(_bound(F.sort_array(hashes), places), covered)

    return F.when(F.size(words) < WINDOW, F.lit(0)).otherwise(_bound(words, of)).cast("bigint")


def statistics(docs: DataFrame) -> DataFrame:
    """One row of counts per document: ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_upper,
    n_marks, n_digits, n_lines`` (longs), from the whole text; a null text counts as empty."""
    text = F.coalesce(F.col("text"), F.lit(""))
    split = docs.select("doc_id", text.alias("text"), F.filter(F.split(text, GAP, -1), lambda w: w != "").alias("words"))

    def without(chars: str) -> Column:
        return F.length("text") - F.length(F.translate("text", chars, ""))

    lines = F.filter(F.split("text", "\n", -1), lambda x: F.translate(x, BLANKS, "") != "")
    counts = {
        "n_words": F.size("words"),
        "word_chars": F.length(F.translate("text", BLANKS, "")),
        "n_symbols": without(SYMBOLS),
        "n_dup_lines": _bound(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))),
        "n_repeat_words": repeat_words(F.col("words")),
        "n_upper": F.length("text") - F.length(F.regexp_replace("text", r"\p{Lu}+", "")),
        "n_marks": without("!?"),
        "n_digits": without("0123456789"),
        "n_lines": F.size(lines),
    }
    return split.select("doc_id", *[c.cast("bigint").alias(n) for n, c in counts.items()])


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    threshold: float

    def holds(self) -> Column:
        value = F.expr(FEATURES[self.feature])
        return value >= F.lit(self.threshold) if self.above else value < F.lit(self.threshold)

    def __str__(self) -> str:
        return f"{self.feature} {'>=' if self.above else '<'} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _all(rule: Rule) -> Column:
    return reduce(lambda a, b: a & b, [c.holds() for c in rule], F.lit(True))


def verdict(rules: list[Rule]) -> Column:
    """The decision list as an ordered conditional: false where the first matching rule rejects, true if none matches."""
    out = F.when(F.lit(False), F.lit(False))
    for rule in rules:
        out = out.when(_all(rule), F.lit(False))
    return out.otherwise(F.lit(True))


def learn(
    labelled: DataFrame,
    max_rules: int = 8,
    max_conditions: int = 3,
    steps: int = 16,
    min_precision: float = 0.9,
    min_support: float = 0.002,
    seed: str = "rules",
) -> list[Rule]:
    """Rules for the rows with ``low`` true in ``labelled`` (statistics, ``doc_id``, ``low``).

    ``steps`` quantiles of each class are the thresholds of a feature. A rule is taken if at least ``min_precision`` of
    the pruning rows that it covers are low and it covers at least ``min_support`` of the low ones; the first rule that
    fails ends the list. No rows, or rows of one class only, give an empty list. Rows with a null label are left out.
    """
    rows = labelled.where("low IS NOT NULL").withColumn("growing", md5_int(F.lit(seed), "doc_id") % 3 != 0)
    rows = materialise(rows.select("low", "growing", *[F.expr(e).alias(n) for n, e in FEATURES.items()]), "labelled")
    shares = [k / steps for k in range(1, steps)] + [0.01, 0.99]
    cuts = rows.groupBy("low").agg(*[F.percentile_approx(n, shares, 1000).alias(n) for n in FEATURES]).collect()  # two rows at most
    grid = {n: sorted({v for r in cuts for v in r[n]}) for n in FEATURES}
    names = list(FEATURES)

    def step(n: str) -> Column:
        """How many thresholds of the feature the value reaches."""
        return F.size(F.filter(F.array(*[F.lit(float(t)) for t in grid[n]]), lambda t: F.col(n) >= t)) if grid[n] else F.lit(0)

    binned = materialise(rows.select("low", "growing", F.array(*[step(n) for n in names]).alias("bins")), "binned")

    def holds(rule: list[tuple[int, bool, int]]) -> Column:
        parts = [F.get("bins", F.lit(f)) >= k if above else F.get("bins", F.lit(f)) < k for f, above, k in rule]
        return reduce(lambda a, b: a & b, parts, F.lit(True))

    def grow(rows: DataFrame) -> list[tuple[int, bool, int]]:
        rule: list[tuple[int, bool, int]] = []
        while len(rule) < max_conditions:
            inside = rows.where(holds(rule)) if rule else rows
            counts = inside.select("low", F.posexplode("bins").alias("f", "bin")).groupBy("f", "bin").agg(F.count_if("low").alias("p"), F.count_if(~F.col("low")).alias("n"))
            table = {(r["f"], r["bin"]): (r["p"], r["n"]) for r in counts.collect()}  # features x thresholds at most
            p0, n0 = (sum(v[i] for (f, _), v in table.items() if f == 0) for i in (0, 1))
            if not p0 or not n0:
                break
            best = max(_literals(table, len(names), p0, n0), default=None)
            if best is None or best[0] <= 0:
                break
            rule.append(best[1:])
        return rule

    total = binned.agg(F.count_if("low")).first()[0] or 0
    rules: list[list[tuple[int, bool, int]]] = []
    while len(rules) < max_rules and total:
        left = reduce(lambda d, r: d.where(~holds(r)), rules, binned)
        rule = grow(left.where("growing"))
        if not rule:
            break
        heads = [rule[: k + 1] for k in range(len(rule))]
        seen = left.where("NOT growing").agg(*[f(holds(h) & c) for h in heads for f, c in ((F.count_if, F.col("low")), (F.count_if, ~F.col("low")))]).first()
        worth = [((p - n) / (p + n) if p + n else -1.0, p, n, -k, heads[k]) for k, (p, n) in enumerate(zip(seen[::2], seen[1::2]))]
        _, p, n, _, head = max(worth, key=lambda w: (w[0], w[3]))
        if p + n == 0 or p / (p + n) < min_precision or p < min_support * total / 3:
            break
        rules.append(head)
    return [tuple(Condition(names[f], above, float(grid[names[f]][k - 1])) for f, above, k in rule) for rule in rules]


def _literals(table: dict, features: int, p0: int, n0: int):
    """``gain, feature, above, threshold number`` of every single threshold, from the counts by bin."""
    before = log2(p0 / (p0 + n0))
    for f in range(features):
        bins = sorted(b for g, b in table if g == f)
        p = n = 0
        for low, high in zip(bins, bins[1:]):
            p, n = p + table[f, low][0], n + table[f, low][1]
            for above, q, m in ((False, p, n), (True, p0 - p, n0 - n)):
                if q:
                    yield q * (log2(q / (q + m)) - before), f, above, high


def judge(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """Statistics of every row of ``docs`` with ``base_failed`` and ``kept``.

    ``labels(doc_id, quality)`` with quality 0 for low; null and unknown ids are left out. Rows that fail the base filter
    are rejected and take no part in learning. Null ids and repeated rows are judged like any other.
    """
    stats = materialise(statistics(docs), "statistics").withColumn("base_failed", base_failed())
    marks = labels.where("quality IS NOT NULL").select(F.col("doc_id").alias("labelled_id"), (F.col("quality") == 0).alias("low"))
    labelled = stats.where("NOT base_failed").join(marks, F.col("doc_id") == F.col("labelled_id")).drop("labelled_id")
    rules = learn(labelled, **options)
    return stats.withColumn("kept", ~F.col("base_failed") & verdict(rules))
