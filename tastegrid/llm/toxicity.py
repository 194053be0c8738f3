"""Toxicity from two class-conditional Kneser-Ney models over the words of a text.

A word is spelled as a path of prefixes, of one to ``DEPTH`` letters, that ends in the word itself: longer words share their
first ``DEPTH`` letters and are told apart by the last step, so no letter of a word goes unread. Each class has its own discounted counts along the
path; what the discount sets free goes to one backoff distribution for both classes: their joint counts, discounted in turn
in favour of Kneser-Ney's continuation counts, in how many different words of the whole corpus a prefix continues so. A
rare or unseen form of an expression thus falls back on the forms it shares its beginning with. A document's score
compares the two log-likelihoods per word.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tastegrid.functions.hashing import md5_int
from tastegrid.llm.registry import boxed, unboxed
from tastegrid.session import materialise

#: At most so many labelled documents (in expectation, chosen by a hash) teach the models; the corpus counts use all rows.
MAX_LABELLED = 50_000
#: Words that a task scores at once, and different words whose ratios it remembers.
CHUNK = 200_000
MEMORY = 300_000
#: Letters of the longest prefix that is a context; the step after it is the whole word.
DEPTH = 8
DISCOUNT = 0.75
#: A step with n training documents behind it counts n / (n + CAUTION).
CAUTION = 8.0
WINDOW = 100
THRESHOLD = 0.7
CLIP = 8.0
MARGIN = 2.0

_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def held_out(id_col: str = "doc_id") -> Column:
    """Rows whose labels are never read: crc32 of the id as text leaves 1 modulo 3. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def labelled_sample(labels: DataFrame, max_labelled: int = MAX_LABELLED, seed: str = "toxicity") -> DataFrame:
    """``labelled_id, cell``: training rows as 2 * fold + toxic; ids with labels that disagree are left out."""
    own = labels.where("toxic IN (0, 1) AND doc_id IS NOT NULL").where(~held_out())
    own = own.groupBy("doc_id").agg(F.min("toxic").alias("toxic"), F.max("toxic").alias("most")).where("toxic = most")
    own = materialise(own.select("doc_id", "toxic"), "labels")
    n = own.count()
    if n > max_labelled:
        own = own.where(md5_int(F.lit(seed), F.lit("sample"), "doc_id") < int(2**32 * max_labelled / n))
    fold = (md5_int(F.lit(seed), F.lit("fold"), "doc_id") % 2).cast("int")
    return own.select(F.col("doc_id").alias("labelled_id"), (2 * fold + F.col("toxic")).cast("int").alias("cell"))


CELLS = ["o0", "t0", "o1", "t1"]


def word_counts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """``word, o0, t0, o1, t1``: every word of the corpus, and in how many training documents of a fold and class it is.

    Tasks pass on one row per word and batch of documents, summed by Spark.
    """
    marked = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("labelled_id"), "left").select("text", "cell")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [Counter() for _ in range(len(CELLS) + 1)]  # the last one holds words of unlabelled rows
        for b in batches:
            for text, cell in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[len(CELLS) if cell is None else cell].update(set(words_of(text)))
                if sum(map(len, seen)) > 250_000:
                    yield rows(seen)
                    seen = [Counter() for _ in seen]
        yield rows(seen)

    def rows(seen: list[Counter]) -> pa.RecordBatch:
        words = list(set().union(*seen))
        cells = [pa.array([own.get(w, 0) for w in words] if own else np.zeros(len(words), np.int64), pa.int64()) for own in seen[:-1]]
        return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), *cells], names=["word", *CELLS])

    counts = marked.mapInArrow(run, "word string, " + ", ".join(f"{c} long" for c in CELLS))
    return counts.groupBy("word").agg(*[F.sum(c).alias(c) for c in CELLS])


def nodes(words: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``node, parent, o0, t0, o1, t1, types``: every prefix and, marked by a dollar, every whole word; ``types`` counts
    the different words of the corpus below the node."""
    cuts = F.transform(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(depth))), lambda k: F.struct(F.substring("word", F.lit(1), k).alias("node"), F.substring("word", F.lit(1), k - 1).alias("parent")))
    whole = F.array(F.struct(F.concat("word", F.lit("$")).alias("node"), F.substring("word", 1, depth).alias("parent")))
    paths = words.select(F.explode(F.concat(cuts, whole)).alias("p"), *CELLS)
    return paths.groupBy("p.node", "p.parent").agg(*[F.sum(c).alias(c) for c in CELLS], F.count(F.lit(1)).alias("types"))


def model(tree: DataFrame, folds: tuple[int, ...], discount: float = DISCOUNT) -> DataFrame:
    """``node, step, back``: log-likelihood ratio of taking the step to the node, and of leaving the known words below it.

    All nodes that two labelled documents hold are kept, and so are their parents.
    """
    t, o = (sum((F.col(f"{c}{k}") for k in folds), F.lit(0)) for c in "to")
    own = tree.select("node", "parent", "types", t.alias("t"), o.alias("o"))
    # both classes count as if they had as many words as the toxic one, so that neither has more mass to give to unseen words
    sizes = own.where("parent = ''").agg(F.sum("t"), F.sum("o")).first()
    scale = sizes[0] / sizes[1] if sizes[0] and sizes[1] else 1.0
    own = own.withColumn("even", F.col("o") * scale)

    def taken(c: str) -> Column:
        """Discount of a count; of a scaled one, what it would be on average in a sample of that size."""
        return discount * ((F.col(c) > 0).cast("double") if c == "t" else 1 - F.exp(-F.col(c)))

    own = own.withColumn("both", F.col("t") + F.col("o"))
    below = own.groupBy(F.col("parent").alias("at")).agg(
        F.sum("t").alias("t_all"), F.sum("even").alias("even_all"), F.sum(taken("t")).alias("t_spare"), F.sum(taken("even")).alias("even_spare"),
        F.sum("both").alias("both_all"), F.count_if(F.col("both") > 0).alias("both_kinds"), F.sum("types").alias("types_all"),
    )

    def freed(c: str) -> Column:
        """Mass that the class leaves to the shared counts below a node."""
        return F.when(F.col(f"{c}_all") > 0, F.col(f"{c}_spare") / F.col(f"{c}_all")).otherwise(1.0)

    below = below.withColumns({"t_free": freed("t"), "even_free": freed("even")})
    kept = own.where("both >= 2")
    kept = kept.join(below.alias("up"), F.col("parent") == F.col("up.at"))
    shared = F.greatest(F.col("both") - discount, F.lit(0.0)) / F.col("both_all")
    shared = shared + discount * F.col("both_kinds") / F.col("both_all") * F.col("types") / F.col("types_all")

    def chance(c: str) -> Column:
        return F.when(F.col(f"{c}_all") > 0, (F.col(c) - taken(c)) / F.col(f"{c}_all")).otherwise(0.0) + F.col(f"{c}_free") * shared


    def cautious(ratio: Column, n: Column) -> Column:
        return ratio * n / (n + CAUTION)

    kept = kept.select("node", cautious(F.log(chance("t")) - F.log(chance("even")), F.col("t") + F.col("even")).alias("step"))
    leave = below.select(F.col("at").alias("node"), cautious(F.log("t_free") - F.log("even_free"), F.col("t_all") + F.col("even_all")).alias("back"))
    return kept.join(leave, "node", "left").select("node", "step", F.coalesce("back", F.lit(0.0)).alias("back"))


Model = dict[str, tuple[float, float]]

#: The same as three arrays, sorted by the hash of the node: 24 bytes per node.
Packed = tuple[np.ndarray, np.ndarray, np.ndarray]


def _hashes(nodes: list[str]) -> np.ndarray:
    """Spark's xxhash64 of the nodes."""
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(x.encode("utf-8", "surrogatepass"), 42) for x in nodes), dtype=np.uint64, count=len(nodes))


def packed(rows: DataFrame) -> Packed:
    """All nodes of the model: as many as two of the bounded sample's documents share, whatever the corpus."""
    table = rows.select(F.xxhash64("node").alias("node"), "step", "back").toArrow()
    own = table["node"].to_numpy().view(np.uint64)
    order = np.argsort(own, kind="stable")
    return own[order], table["step"].to_numpy()[order], table["back"].to_numpy()[order]


def _collected(spark: SparkSession, rows: DataFrame):
    return spark.sparkContext.broadcast(packed(rows))


def _path(word: str, depth: int = DEPTH) -> list[str]:
    return [*(word[:k] for k in range(1, min(len(word), depth) + 1)), word + "$"]


def word_ratios(words: list[str], known: Packed, depth: int = DEPTH) -> np.ndarray:
    """:func:`word_ratio` of many words at once, step by step along their paths, each as far as the model knows it."""
    nodes, steps, backs = known
    total, back = np.zeros(len(words)), np.zeros(len(words))
    on, lengths = np.arange(len(words)), np.minimum(np.fromiter(map(len, words), np.int64, len(words)), depth)
    for k in range(1, depth + 2):
        if not len(on) or not len(nodes):
            break
        last = lengths[on] < k  # the step after the longest prefix is the word itself
        own = _hashes([words[i] + "$" if end else words[i][:k] for i, end in zip(on.tolist(), last.tolist())])
        at = np.minimum(np.searchsorted(nodes, own), len(nodes) - 1)
        found = nodes[at] == own
        total[on[~found]] += back[on[~found]]
        on, at, last = on[found], at[found], last[found]
        total[on] += steps[at]
        back[on] = backs[at]
        on = on[~last]
    return np.clip(total, -CLIP, CLIP)


def word_ratio(word: str, known: Model, depth: int = DEPTH) -> float:
    """Log-likelihood ratio of a word: the steps along its prefixes, up to where the model knows no further."""
    total, back = 0.0, 0.0
    for node in _path(word, depth):
        found = known.get(node)
        if found is None:
            total += back
            break
        total += found[0]
        back = found[1]
    return max(-CLIP, min(CLIP, total))


class Reader:
    """Evidence of texts by one model. Every different word is looked up once and remembered."""

    def __init__(self, known: Packed):
        self.known = known
        self._forget()

    def _forget(self) -> None:
        self.ids: defaultdict[str, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.ratios = np.zeros(0)

    def features(self, texts: list[list[str]]) -> np.ndarray:
        """For each text the mean ratio of its words; of what is above ``MARGIN`` in them the sum per word, once as a root
        and once damped for short texts; and one over the root of the number of words. A word counts once in ``WINDOW``
        words, so that a repeated one adds little."""
        if len(self.ids) > MEMORY:
            self._forget()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.fromiter((self.ids[w] for words in texts for w in words), np.int64, int(lengths.sum()))
        new = list(islice(self.ids, len(self.ratios), None))
        if new:
            self.ratios = np.concatenate([self.ratios, word_ratios(new, self.known)])
        windows = -(-lengths // WINDOW)
        place = np.arange(len(at)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        window = np.repeat(np.cumsum(windows) - windows, lengths) + place // WINDOW
        once = np.unique(window * max(1, len(self.ids)) + at)
        text = np.repeat(np.arange(len(texts)), windows)[once // max(1, len(self.ids))]
        ratio = self.ratios[once % max(1, len(self.ids))]
        n = np.maximum(lengths, 1)
        mean = np.bincount(text, ratio, len(texts)) / np.maximum(np.bincount(text, minlength=len(texts)), 1)
        strong = np.bincount(text, np.maximum(ratio - MARGIN, 0.0), len(texts))
        return np.column_stack([mean, np.sqrt(strong / n), strong / (n + 25), n**-0.5])

    def read(self, texts: list[str | None]) -> np.ndarray:
        """:meth:`features` of texts, a bounded number of words at a time."""
        out, held, n = [np.zeros((0, FEATURES))], [], 0
        for text in texts:
            held.append(words_of(text))
            n += len(held[-1])
            if n >= CHUNK:
                out.append(self.features(held))
                held, n = [], 0
        return np.concatenate([*out, self.features(held)])


FEATURES = 4


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 100) -> np.ndarray:
    """Intercept and weights of a logistic regression, by Newton steps that are halved until they gain, on a bounded
    sample. With one class only, its rate as the intercept."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    a = np.c_[np.ones(len(x)), x]
    w = np.zeros(a.shape[1])
    w[0] = np.log(rate / (1 - rate))
    if not len(y) or y.min() == y.max():
        return w
    scale = np.r_[1.0, a[:, 1:].std(axis=0) + 1e-9]
    a, keep = a / scale, np.r_[0.0, np.full(a.shape[1] - 1, ridge)]

    def loss(w: np.ndarray) -> float:
        z = a @ w
        return float(np.logaddexp(0, z).sum() - y @ z + keep @ (w * w) / 2)

    now = loss(w)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        move = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag(keep + 1e-6), a.T @ (y - p) - keep * w)
        part = 1.0
        while part > 1e-4 and loss(w + part * move) > now:
            part /= 2
        w = w + part * move
        before, now = now, loss(w)
        if before - now < 1e-7:
            break
    return w / scale


def toxicity(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for every row of ``docs``.

    ``score`` is the calibrated chance of label 1, from the text alone. Weights of the calibration are fitted on training
    rows, each scored by a model of the other fold. Null and empty texts have a score as well: that of no evidence.
    Repeated rows and null ids are scored like any other; without labels all scores are the same. Extra columns are
    ignored; an empty table gives an empty one.
    """
    return _scored(docs.select("doc_id", held_out().alias("held_out"), "text"), docs, labels, max_labelled, threshold).drop("text")


def drop_toxic(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold; all columns stay, of null ids and repeated rows too."""
    rows = boxed(docs, text=F.col("text"))
    kept = _scored(rows, docs, labels, max_labelled, threshold).where("predicted = 0")
    return kept.select(*unboxed(rows, docs.columns))


def _scored(rows: DataFrame, docs: DataFrame, labels: DataFrame, max_labelled: int, threshold: float) -> DataFrame:
    """``rows`` (with a column ``text``) plus ``score`` and ``predicted``, by models learned from ``docs`` and ``labels``."""
    spark = docs.sparkSession
    sample = materialise(labelled_sample(labels, max_labelled), "sample")
    tree = materialise(nodes(word_counts(docs, sample)), "nodes")
    halves = [_collected(spark, model(tree, (k,))) for k in (1, 0)]  # by fold of the row that is scored

    names = [f"x{k}" for k in range(FEATURES)]

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        readers = [Reader(h.value) for h in halves]
        for b in batches:
            cells = b.column(1).to_numpy()
            out = np.zeros((len(cells), FEATURES))
            for fold in (0, 1):
                own = np.flatnonzero(cells // 2 == fold)
                out[own] = readers[fold].read(b.column(0).take(pa.array(own)).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(cells % 2, pa.int32()), *(pa.array(c) for c in out.T)], names=["y", *names])

    own = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("labelled_id")).select("text", "cell")
    seen = own.mapInArrow(cross, ", ".join(["y int", *(f"{x} double" for x in names)])).toArrow()  # a row of numbers for each of the bounded sample
    x = np.column_stack([seen[c].to_numpy() for c in names]) if len(seen) else np.zeros((0, FEATURES))
    weights = fit(x, seen["y"].to_numpy().astype(float)) if len(seen) else np.zeros(FEATURES + 1)
    known = _collected(spark, model(tree, (0, 1)))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Reader(known.value)
        for b in batches:
            z = np.clip(weights[0] + reader.read(b.column("text").to_pylist()) @ weights[1:], -30, 30)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(1 / (1 + np.exp(-z)), pa.float64())], names=[*b.schema.names, "score"])

    scored = rows.mapInArrow(score, StructType([*rows.schema.fields, StructField("score", DoubleType())]))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


__all__ = ["toxicity", "drop_toxic", "held_out"]
