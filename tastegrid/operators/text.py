"""Keyword strings, review texts and categorical encoding. Rows are ``(name, keywords)`` or ``(id, text)``."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.functions.ranking import top_k

OTHER = "Other"


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _tidy(c: Column) -> Column:
    """One comma and blank between keywords, single blanks, none at the ends."""
    c = F.regexp_replace(c, r"\s*,\s*", ", ")
    c = F.regexp_replace(c, r"\s+", " ")
    return F.regexp_replace(c, r"^[ ,]+|[ ,]+$", "")


def strip_labels(c: str | Column, labels: Sequence[str]) -> Column:
    """``[Label] {x}`` of the given labels (any case) and ``[] {x}`` become x."""
    names = "|".join(re.escape(n).replace(r"\ ", " ") for n in labels)
    c = F.regexp_replace(_col(c), r"\.+$", "")
    c = F.regexp_replace(c, r"(?i)\[(" + names + r")\]\s*\{([^}]+)\}", "$2")
    return _tidy(F.regexp_replace(c, r"\[\]\s*\{([^}]+)\}", "$1"))


def clean_keywords(df: DataFrame, labels: Sequence[str]) -> DataFrame:
    """Rows with keywords, cleaned."""
    kept = df.filter(F.trim("keywords") != "")
    return kept.withColumn("keywords", strip_labels("keywords", labels))


def clean_column(c: str | Column) -> Column:
    """As :func:`strip_labels` for any label."""
    c = F.regexp_replace(_col(c), r"\.+$", "")
    return _tidy(F.regexp_replace(c, r"\[[^\]]*\]\s*\{([^}]+)\}", "$1"))


def extract_braced(c: str | Column) -> Column:
    """Array of the texts in braces, each cut at its first comma and then its first slash."""
    groups = F.regexp_extract_all(_col(c), F.lit(r"\{([^}]+)\}"), F.lit(1))
    return F.transform(groups, lambda g: F.trim(F.split_part(F.trim(F.split_part(g, F.lit(","), F.lit(1))), F.lit("/"), F.lit(1))))


def parse_labelled_entry(entry: str | Column, labels: Sequence[str]) -> Column:
    """Struct (label, value) of ``[Label] {value}``; an unknown label or a bare ``[value]`` goes to 'Keywords'."""
    e = F.trim(_col(entry))
    full, bare = r"^\[(\w+)\]\s*\{([^}]+)\}", r"^\[([^\]]+)\]"
    label = F.lower(F.regexp_extract(e, full, 1))
    known = label.isin([n.lower() for n in labels])
    return F.when(
        e.rlike(full), F.struct(F.when(known, label).otherwise("Keywords").alias("label"), F.trim(F.regexp_extract(e, full, 2)).alias("value"))
    ).when(e.rlike(bare), F.struct(F.lit("Keywords").alias("label"), F.trim(F.regexp_extract(e, bare, 1)).alias("value")))


def normalise_keywords(df: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """(name, words): square brackets dropped, keywords split, trimmed, lower-cased and replaced by their lemma
    from an optional ``(form, lemma)`` table."""
    flat = F.regexp_replace("keywords", r"\[(.*?)\]", "$1")
    words = F.transform(F.split(flat, ","), lambda w: F.lower(F.trim(w)))
    rows = df.select("name", F.filter(words, lambda w: w != "").alias("words"))
    if lemmas is None:
        return rows
    return apply_mapping(rows, lemmas.select(F.col("form").alias("word"), F.col("lemma").alias("representative")))


def keyword_counts(rows: DataFrame) -> DataFrame:
    """(word, count) over all rows, most frequent first."""
    return rows.select(F.explode("words").alias("word")).groupBy("word").count().orderBy(F.desc("count"), "word")


def cluster_representative(clusters: DataFrame, counts: DataFrame) -> DataFrame:
    """(word, representative): the most frequent word of the word's cluster ``(word, cluster)``."""
    sized = clusters.join(counts, "word", "left").withColumn("count", F.coalesce("count", F.lit(0)))
    best = sized.groupBy("cluster").agg(F.min(F.struct(-F.col("count"), F.col("word").alias("w"))).alias("b"))
    return clusters.join(best, "cluster").select("word", F.col("b.w").alias("representative"))


def frequency_threshold(counts: DataFrame, threshold: int) -> DataFrame:
    """Words with at least ``threshold`` rows; 0 keeps all."""
    return counts.filter(F.col("count") >= threshold) if threshold > 0 else counts


def apply_mapping(rows: DataFrame, mapping: DataFrame, distinct: bool = False) -> DataFrame:
    """Each row's words mapped in order, unmapped ones kept; repeats optionally dropped after the first."""
    long = rows.select("name", F.posexplode_outer("words").alias("pos", "word"))
    mapped = long.join(mapping, "word", "left").withColumn("word", F.coalesce("representative", "word"))
    pairs = F.sort_array(F.collect_list(F.when(F.col("pos").isNotNull(), F.struct("pos", "word"))))
    words = F.transform(pairs, lambda p: p["word"])
    return mapped.groupBy("name").agg((F.array_distinct(words) if distinct else words).alias("words"))


def _by_label(rows: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(name, label, word): the i-th word under the i-th label, null past the end."""
    picks = F.array(*[F.struct(F.lit(n).alias("label"), F.try_element_at("words", F.lit(i + 1)).alias("word")) for i, n in enumerate(labels)])
    return rows.select("name", F.explode(picks).alias("p")).select("name", "p.label", "p.word")


def count_by_category(rows: DataFrame, labels: Sequence[str], n: int) -> DataFrame:
    """(label, word, count, rank): the ``n`` most frequent words of each label."""
    counts = _by_label(rows, labels).filter(F.col("word") != "").groupBy("label", "word").count()
    return top_k(counts, ["label"], [F.desc("count"), F.asc("word")], n)


def assign_categories(rows: DataFrame, top: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(name, label, word): words outside the label's top list and missing ones become 'Other'."""
    listed = top.select("label", "word", F.lit(True).alias("_in"))
    return _by_label(rows, labels).join(listed, ["label", "word"], "left").select(
        "name", "label", F.when(F.col("_in"), F.col("word")).otherwise(F.lit(OTHER)).alias("word")
    )


def other_histogram(assigned: DataFrame, labels: Sequence[str]) -> DataFrame:
    """(others, rows): rows by how many of their labels are 'Other', empty buckets kept."""
    per_row = assigned.groupBy("name").agg(F.count_if(F.col("word") == OTHER).alias("others"))
    got = per_row.groupBy("others").agg(F.count(F.lit(1)).alias("rows"))
    buckets = assigned.sparkSession.range(len(labels) + 1).withColumnRenamed("id", "others")
    return buckets.join(got, "others", "left").na.fill(0, ["rows"])


def others_per_label(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("label").agg(F.count_if(F.col("word") == OTHER).alias("others"))


def one_hot_categories(assigned: DataFrame, top: DataFrame, suffix: str = ".jpg") -> DataFrame:
    """(name, label, categories, flags): lower-cased sorted categories of the label, 'other' last."""
    cats = top.groupBy("label").agg(F.array_sort(F.collect_set(F.lower("word"))).alias("c"))
    cats = cats.select("label", F.when(F.array_contains("c", "other"), F.col("c")).otherwise(F.array_append("c", F.lit("other"))).alias("categories"))
    value = F.lower("word")
    return assigned.join(cats, "label").withColumn("_v", value).select(
        F.replace("name", F.lit(suffix), F.lit("")).alias("name"), "label", "categories",
        F.transform("categories", lambda c: (c == F.col("_v")).cast("int")).alias("flags"),
    )


# The clean-up patterns of review texts, in order.
_REVIEW_PATTERNS = [
    (r"[^A-Za-z0-9',.!;?()]", " "),
    (r"\.", " . "),
    (r"!+", " ! "),
    (r",", " , "),
    (r";", " ; "),
    (r"!", " ! "),
    (r"\(", " ( "),
    (r"\)", " ) "),
    (r"\?", " ? "),
    (r"\s{2,}", " "),
    (r"(\.|\s){7,}", " ... "),
]
_CONTRACTIONS = ["'s", "'ve", "n't", "'re", "'d", "'m", "'ll"]
_STRAY_APOSTROPHE = r"(?!(('(?=s\b))|('(?=ve\b))|('(?=re\b))|('(?=d\b))|('(?=ll\b))|('(?=m\b))|((?<=n\b)'(?=t\b))))'"
_DIGITS = ["zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine"]

# A run of two or more single letters with dots ("e . g .") is drawn together letter by letter.
_INITIALS = r"(?:\G(?!^)|(?<= )(?=\w \. \w \.))(\w) \.( (?=\w \.))?"


def clean_review_text(c: str | Column) -> Column:
    """Allowed characters only, punctuation set apart, dot runs and initials drawn together, contractions split,
    single digits in words. Case and outer blanks stay."""
    c = _col(c)
    for pattern, with_ in _REVIEW_PATTERNS:
        c = F.regexp_replace(c, pattern, with_)
    c = F.regexp_replace(c, _INITIALS, "$1.")
    for tail in _CONTRACTIONS:
        c = F.replace(c, F.lit(tail), F.lit(" " + tail))
    c = F.regexp_replace(c, _STRAY_APOSTROPHE, " ")
    for digit, word in enumerate(_DIGITS):
        c = F.replace(c, F.lit(f" {digit} "), F.lit(f" {word} "))
    return F.regexp_replace(c, r"\s{2,}", " ")


def split_sentences(c: str | Column, delimiter: str = ".") -> Column:
    """Array of the pieces of a text; the delimiter stays with the piece before it."""
    return F.split(_col(c), "(?<=" + re.escape(delimiter) + ")")


def text_by_id(df: DataFrame, keys: Sequence[str], text: str) -> DataFrame:
    """(id, text): the id is the key column, or several joined by two underscores."""
    return df.select(F.concat_ws("__", *[F.col(k).cast("string") for k in keys]).alias("id"), F.col(text).alias("text"))
