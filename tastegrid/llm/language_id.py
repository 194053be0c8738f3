"""Language identification by a linear-chain conditional random field over the words of a text.

A word's score for each language is the sum of the weights of its features: character n-grams and affixes (n-grams that
touch a word's border), hashed into a table, and what a lexicon of the corpus says of it. Scores of neighbouring words are
tied by learned transition weights; forward-backward turns both into the chance of every language for every word, so the
words of code-switched texts get labels of their own. A text's language is the one that its words have most of.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.session import materialise

#: The field is fitted on so many words (in expectation, the same number of each language), taken in segments of whole
#: neighbouring words from all labelled rows by a hash of the text; the lexicon counts every word of every labelled row.
TRAIN_WORDS = 240_000
SEGMENT = 16
#: Segments of a training sequence; neighbours come from different texts, mostly of different languages.
MIXED = 3
#: The lexicon holds words with at least this part of a language's words, so at most 1 / LEXICON_SHARE of each language.
LEXICON_SHARE = 1e-5
LEXICON_LEAST = 5
BITS = 18
ORDERS = (1, 2, 3, 4)
#: Only n-grams of this order that touch a border are features.
AFFIX = 5
EPOCHS = 6
BATCHES = 24
RATE = 0.15
RIDGE = 1e-5
#: Numbers (words x languages) that a task scores at once, and words whose scores it remembers.
CHUNK = 2_000_000
MEMORY = 500_000
#: Positions that are multiplied into one matrix before texts are followed from end to end.
STRIDE = 32
UNKNOWN = "und"

_WORDS = re.compile(r"[^\W\d_]+")
_BEGIN, _END = "\x02", "\x03"


def words_of(text: str | None) -> list[str]:
    """Lower-cased runs of letters. A run without a letter (vulgar fractions and the like) is no word."""
    return [w for w in _WORDS.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that are never learned from: crc32 of the id as text leaves 1 modulo 3. Null ids are not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


# --- features ---------------------------------------------------------------------------------------------


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """``word, bucket`` of every feature of the words, for all words at once."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    text = "".join(f"{_BEGIN}{w}{_END}" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.cumsum(lengths)
    word = np.repeat(np.arange(len(words)), lengths)
    to_end = np.repeat(ends, lengths) - np.arange(len(codes))  # characters from here to the end of the word, this one in
    from_start = np.arange(len(codes)) - np.repeat(ends - lengths, lengths)
    found, buckets = [], []
    rolled = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, min(AFFIX, len(codes)) + 1):
            rolled[: len(codes) - n + 1] = rolled[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :] + np.uint64(1)
            inside = to_end >= n
            if n == 1:
                inside &= (from_start > 0) & (to_end > 1)
            if n not in ORDERS:
                inside &= (from_start == 0) | (to_end == n)
            at = np.flatnonzero(inside)
            mixed = (rolled[at] ^ (rolled[at] >> np.uint64(29)) ^ np.uint64(n)) * np.uint64(0xBF58476D1CE4E5B9)
            found.append(word[at])
            buckets.append((mixed >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(found), np.concatenate(buckets)


def _digests(words: list[str]) -> np.ndarray:
    digest = xxhash.xxh3_64_intdigest
    return np.fromiter((digest(w.encode("utf-8", "surrogatepass")) for w in words), np.uint64, len(words))


class Lexicon:
    """For the frequent words, how much more frequent than on average each language has them (logarithms)."""

    def __init__(self, words: list[str], counts: np.ndarray, totals: np.ndarray):
        rates = (counts + 0.1) / (totals + 1.0)
        table = np.log(rates) - np.log(rates.mean(axis=1, keepdims=True)) if len(words) else np.zeros((0, len(totals)))
        digests = _digests(words)
        order = np.argsort(digests)
        self.digests, self.table = digests[order], table[order].astype(np.float32)

    def of(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Whether a word is known, and its row (zeros for an unknown one)."""
        own = _digests(words)
        if not len(self.digests):
            return np.zeros(len(own), bool), np.zeros((len(own), self.table.shape[1]))
        at = np.minimum(np.searchsorted(self.digests, own), len(self.digests) - 1)
        known = self.digests[at] == own
        return known, np.where(known[:, None], self.table[at], 0.0)


# --- the field --------------------------------------------------------------------------------------------


class Features:
    """What the field looks at in different words."""

    def __init__(self, words: list[str], lexicon: Lexicon):
        self.n = len(words)
        self.word, self.bucket = features(words)
        self.known, self.table = lexicon.of(words)


class Field:
    """Weights of the chain: n-gram table, lexicon (per language, and for unknown words), transitions."""

    def __init__(self, labels: list[str], lexicon: Lexicon):
        n = len(labels)
        self.labels, self.lexicon = labels, lexicon
        self.grams, self.known, self.unknown, self.moves = np.zeros((1 << BITS, n), np.float32), np.ones(n), np.zeros(n), np.zeros((n, n))

    def scores(self, words: list[str]) -> np.ndarray:
        """One row per word: its score for every language, by itself."""
        return self.weigh(Features(words, self.lexicon)) if words else np.zeros((0, len(self.labels)))

    def weigh(self, own: Features) -> np.ndarray:
        grams = np.column_stack([np.bincount(own.word, self.grams[own.bucket, y], own.n) for y in range(len(self.labels))])
        return grams + own.table * self.known + np.where(own.known[:, None], 0.0, self.unknown)


def marginals(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray, stride: int = STRIDE) -> np.ndarray:
    """Chance of every label at every position of chains that stand one after the other in ``scores``.

    Forward-backward over all chains at once. A chain is cut into strides; the transfer matrices of a stride's positions
    are multiplied first, for all strides side by side, then chains are followed stride by stride in both directions, and
    last every stride is filled in from its two ends. Positions that pad a stride, and the step into a chain's first
    position, leave the vector as it is. Vectors and matrices are scaled on the way; scales cancel in the end.
    """
    n, k = scores.shape
    if not n:
        return np.zeros((0, k))
    lengths = np.asarray(lengths, np.int64)
    lengths = lengths[lengths > 0]
    parts = -(-lengths // stride)
    first = np.cumsum(parts) - parts
    chain = np.repeat(np.arange(len(lengths)), lengths)
    place = np.arange(n) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    row, col = first[chain] + place // stride, place % stride
    total = int(parts.sum())
    given = np.ones((total, stride, k))
    given[row, col] = np.exp(scores - scores.max(axis=1, keepdims=True))
    moving = np.zeros((total, stride, 1), bool)
    moving[row, col, 0] = place > 0
    step = np.exp(moves)

    product = np.broadcast_to(np.eye(k), (total, k, k)).copy()
    for t in range(stride):
        product = np.where(moving[:, t, None], product @ step, product) * given[:, t, None, :]
        product /= product.max(axis=(1, 2), keepdims=True)
    ahead, behind = np.ones((total, k)), np.ones((total, k))
    order = np.argsort(-parts, kind="stable")
    at, count = first[order], parts[order]
    for t in range(1, int(count[0]) if len(count) else 0):
        live = at[: np.searchsorted(-count, -t, "left")] + t  # chains with more than t strides
        vector = np.einsum("ni,nij->nj", ahead[live - 1], product[live - 1])
        ahead[live] = vector / vector.max(axis=1, keepdims=True)
    last = at + count - 1
    for t in range(1, int(count[0]) if len(count) else 0):
        live = last[: np.searchsorted(-count, -t, "left")] - t
        vector = np.einsum("nij,nj->ni", product[live + 1], behind[live + 1])
        behind[live] = vector / vector.max(axis=1, keepdims=True)

    out = np.empty((total, stride, k))
    for t in range(stride):
        ahead = np.where(moving[:, t], ahead @ step, ahead) * given[:, t]
        ahead /= ahead.max(axis=1, keepdims=True)
        out[:, t] = ahead
    for t in range(stride - 1, -1, -1):
        out[:, t] *= behind
        behind = behind * given[:, t]
        behind = np.where(moving[:, t], behind @ step.T, behind)
        behind /= behind.max(axis=1, keepdims=True)
    found = out[row, col]
    return found / found.sum(axis=1, keepdims=True)


def pair_marginals(scores: np.ndarray, chances: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Expected number of moves from label to label over all chains, from the chances of single positions.

    The chance of labels (i, j) at neighbours is the chance of i times that of j given i; given i, the label to the right
    follows from what lies to the right alone, whose weight is the chance at the right position over what comes from the
    left."""
    after = np.ones(len(scores), bool)
    after[np.cumsum(lengths) - lengths] = False
    right = np.flatnonzero(after)
    step = np.exp(moves)
    left = _forward(scores, lengths, step)
    # right-hand message of position t: chance / forward, up to scale
    message = chances[right] / np.maximum(left[right], 1e-300)
    weight = np.exp(scores[right] - scores[right].max(axis=1, keepdims=True)) * message
    joint = left[right - 1][:, :, None] * step[None] * weight[:, None, :]
    joint /= joint.sum(axis=(1, 2), keepdims=True)
    return joint.sum(axis=0)


def _forward(scores: np.ndarray, lengths: np.ndarray, step: np.ndarray) -> np.ndarray:
    """Scaled forward vectors of short chains, position by position over all of them."""
    given = np.exp(scores - scores.max(axis=1, keepdims=True))
    order = np.argsort(-lengths, kind="stable")
    at, count = (np.cumsum(lengths) - lengths)[order], lengths[order]
    out = given.copy()
    for t in range(1, int(count[0]) if len(count) else 0):
        live = at[: np.searchsorted(-count, -t, "left")] + t
        vector = (out[live - 1] @ step) * given[live]
        out[live] = vector / vector.max(axis=1, keepdims=True)
    return out


def gradient(field: Field, words: Features, chains: list[np.ndarray], truth: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Gradient of the mean log-likelihood per word of ``chains`` (indexes of ``words``) under the labels ``truth``:
    of n-grams, lexicon, unknown words and transitions."""
    n, k = words.n, len(field.labels)
    lengths = np.array([len(c) for c in chains])
    at, own = np.concatenate(chains), np.concatenate(truth)
    scores = field.weigh(words)[at]
    chances = marginals(scores, lengths, field.moves)
    left = -chances
    left[np.arange(len(at)), own] += 1.0
    left /= len(at)
    by_word = np.column_stack([np.bincount(at, left[:, y], n) for y in range(k)])
    grams = np.column_stack([np.bincount(words.bucket, by_word[words.word, y], 1 << BITS) for y in range(k)])
    inner = np.ones(len(at), bool)
    inner[np.cumsum(lengths) - lengths] = False
    right = np.flatnonzero(inner)
    seen = np.bincount(own[right - 1] * k + own[right], minlength=k * k).reshape(k, k)
    moves = (seen - pair_marginals(scores, chances, lengths, field.moves)) / len(at)
    return grams, (by_word * words.table).sum(axis=0), by_word[~words.known].sum(axis=0), moves


def fit(labels: list[str], lexicon: Lexicon, segments: list[tuple[int, list[str]]], epochs: int = EPOCHS, batches: int = BATCHES) -> Field:
    """The field of the ``segments`` (label, words), ``MIXED`` of which make a sequence; AdaGrad over batches of them."""
    field = Field(labels, lexicon)
    sequences = [segments[k : k + MIXED] for k in range(0, len(segments), MIXED)]
    batches = max(1, min(batches, len(sequences) // 4))
    weights = [field.grams, field.known, field.unknown, field.moves]
    speed = [np.full(w.shape, 1e-8) for w in weights]
    prepared = []
    for b in range(batches):
        ids: dict[str, int] = {}
        chains = [np.array([ids.setdefault(w, len(ids)) for _, words in s for w in words]) for s in sequences[b::batches]]
        truth = [np.concatenate([np.full(len(words), y) for y, words in s]) for s in sequences[b::batches]]
        prepared.append((Features(list(ids), lexicon), chains, truth))
    for _ in range(epochs if len(labels) > 1 else 0):
        for words, chains, truth in prepared:
            for w, s, g in zip(weights, speed, gradient(field, words, chains, truth)):
                g = g - RIDGE * w
                s += g * g
                w += (RATE * g / np.sqrt(s)).astype(w.dtype)
    return field


# --- learning from the corpus -------------------------------------------------------------------------------


def word_counts(rows: DataFrame, block: int = 400_000) -> DataFrame:
    """``lang, word, n`` over every word of ``rows(lang, text)``; tasks add up before they send."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = defaultdict(Counter)
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                seen[lang].update(words_of(text))
                if sum(map(len, seen.values())) > block:
                    yield table(seen)
                    seen.clear()
        yield table(seen)

    def table(seen: dict[str, Counter]) -> pa.RecordBatch:
        langs = [lang for lang, c in seen.items() for _ in range(len(c))]
        words = [w for c in seen.values() for w in c]
        counts = [n for c in seen.values() for n in c.values()]
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["lang", "word", "n"])

    counts = rows.select("lang", "text").mapInArrow(run, "lang string, word string, n long")
    return counts.groupBy("lang", "word").agg(F.sum("n").alias("n"))


def lexicon_rows(counts: DataFrame, totals: DataFrame, share: float = LEXICON_SHARE, least: int = LEXICON_LEAST) -> DataFrame:
    """``word, by_lang``: words that some language has often enough, with their counts in all languages."""
    often = (F.col("n") >= least) & (F.col("n") >= share * F.col("total"))
    rows = counts.join(F.broadcast(totals), "lang").withColumn("often", often)
    return rows.groupBy("word").agg(F.max("often").alias("often"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by_lang")).where("often").drop("often")


def training_segments(rows: DataFrame, rates: dict[str, float], seed: str = "language") -> list[tuple[str, list[str]]]:
    """``lang, words`` of the drawn segments, in the order of their hashes. A language's rate is the part of its words to
    draw; texts are drawn first, at up to 16 times the rate, then segments of them."""
    doc_rates = {lang: min(1.0, 16 * r) for lang, r in rates.items()}
    chosen = F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 32)) < F.lit(0)
    for lang, r in doc_rates.items():
        chosen = chosen | ((F.col("lang") == lang) & (F.pmod(F.xxhash64(F.lit(seed), "text"), F.lit(1 << 32)) < F.lit(int(r * (1 << 32)))))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words, inner = words_of(text), rates[lang] / doc_rates[lang]
                own = xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass"))
                for k in range(0, len(words), SEGMENT):
                    key = xxhash.xxh3_64_intdigest(f"{seed}|{own}|{k}")
                    if key < inner * 2**64:
                        out.append((lang, key >> 1, words[k : k + SEGMENT]))
            columns = zip(*out) if out else ((),) * 3
            kinds = (pa.string(), pa.int64(), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names=["lang", "key", "words"])

    drawn = rows.where(chosen).select("lang", "text").mapInArrow(cut, "lang string, key long, words array<string>")
    drawn = sorted((r["key"], r["lang"], r["words"]) for r in drawn.collect())  # TRAIN_WORDS words in expectation
    return [(lang, words) for _, lang, words in drawn]


def learn(docs: DataFrame, lang_col: str = "lang", text_col: str = "text", id_col: str = "doc_id", train_words: int = TRAIN_WORDS) -> Field:
    """The field of the labelled rows that are not held out. Rows without a label or a word teach nothing."""
    rows = docs.where(~held_out(id_col)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    counts = materialise(word_counts(rows), "words")
    totals = materialise(counts.groupBy("lang").agg(F.sum("n").alias("total")), "totals")
    sizes = {r["lang"]: r["total"] for r in totals.collect()}  # a row per language
    labels = sorted(sizes)
    found = lexicon_rows(counts, totals).collect() if labels else []  # at most 1 / LEXICON_SHARE words of each language
    table = np.array([[r["by_lang"].get(y, 0) for y in labels] for r in found], float).reshape(len(found), len(labels))
    lexicon = Lexicon([r["word"] for r in found], table, np.array([sizes[y] for y in labels], float))
    if len(labels) < 2:
        return Field(labels, lexicon)
    segments = training_segments(rows, {y: min(1.0, train_words / len(labels) / sizes[y]) for y in labels})
    return fit(labels, lexicon, [(labels.index(lang), words) for lang, words in segments])


class Tagger:
    """Scores of words by a field; those of words that came before are remembered."""

    def __init__(self, field: Field):
        self.field = field
        self._forget()

    def _forget(self) -> None:
        self.ids: defaultdict[str, int] = defaultdict()
        self.ids.default_factory = self.ids.__len__
        self.table = np.zeros((0, len(self.field.labels)))

    def tag(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Chances of the languages for all words of the texts, one after the other, and the words of each text."""
        if len(self.ids) > MEMORY:
            self._forget()
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        at = np.fromiter((self.ids[w] for words in texts for w in words), np.int64, int(lengths.sum()))
        new = list(islice(self.ids, len(self.table), None))
        if new:
            self.table = np.concatenate([self.table, *(self.field.scores(new[k : k + 50_000]) for k in range(0, len(new), 50_000))])
        return marginals(self.table[at], lengths, self.field.moves), lengths


def _chunks(batches: Iterator[pa.RecordBatch], column: int, most: int) -> Iterator[tuple[pa.RecordBatch, list[list[str]]]]:
    """Rows with the words of their texts, as many rows at once as hold about ``most`` words (one row at least)."""
    for b in batches:
        start, texts, n = 0, [], 0
        for k in range(b.num_rows):
            texts.append(words_of(b.column(column)[k].as_py()))
            n += len(texts[-1])
            if n >= most:
                yield b.slice(start, k + 1 - start), texts
                start, texts, n = k + 1, [], 0
        if texts:
            yield b.slice(start), texts


def identify(docs: DataFrame, field: Field | None = None, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text", train_words: int = TRAIN_WORDS) -> DataFrame:
    """``doc_id, held_out, lang_pred, score`` for every row of ``docs``, by a field learned from them if none is given.

    ``score`` is the mean chance of the language over the text's words. A text that is null or has no letter, and every
    text when no row teaches a language, is ``und`` with score 0. Equal chances go to the first language by name. Repeated
    rows and null ids are read like any other; extra columns are ignored; an empty table gives an empty one.
    """
    field = learn(docs, lang_col, text_col, id_col, train_words) if field is None else field
    shared = docs.sparkSession.sparkContext.broadcast(field)  # n-gram table and lexicon: bounded per language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        names = np.array([*shared.value.labels, UNKNOWN], dtype=object)
        k = len(names) - 1
        for rows, texts in _chunks(batches, 2, max(1, CHUNK // max(1, k))):
            best, score = np.full(len(texts), k), np.zeros(len(texts))
            if k:
                chances, lengths = tagger.tag(texts)
                text = np.repeat(np.arange(len(texts)), lengths)
                mean = np.column_stack([np.bincount(text, chances[:, y], len(texts)) for y in range(k)]) / np.maximum(lengths, 1)[:, None]
                some = lengths > 0
                best[some] = mean[some].argmax(axis=1)
                score[some] = np.clip(mean[some].max(axis=1), 0.0, 1.0)
            yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(names[best].tolist(), pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    given = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return given.mapInArrow(run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def label_words(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, position, word, lang, score`` for every word of every text: the labels of code-switched text. Texts without
    a word have no row."""
    shared = docs.sparkSession.sparkContext.broadcast(field)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = Tagger(shared.value)
        names = np.array(shared.value.labels or [UNKNOWN], dtype=object)
        for rows, texts in _chunks(batches, 1, max(1, CHUNK // (8 * len(names)))):
            chances, lengths = tagger.tag(texts) if shared.value.labels else (np.zeros((sum(map(len, texts)), 1)), np.array([len(t) for t in texts]))
            text = np.repeat(np.arange(len(texts)), lengths)
            position = np.arange(len(text)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
            columns = [rows.column(0).take(pa.array(text)), pa.array(position), pa.array([w for t in texts for w in t], pa.string()), pa.array(names[chances.argmax(axis=1)].tolist(), pa.string()), pa.array(chances.max(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "position", "word", "lang", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, position long, word string, lang string, score double")
