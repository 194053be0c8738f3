"""Line deduplication by site-relative frequency: a line on too large a part of a host's pages is boilerplate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tastegrid.llm.registry import boxed, unboxed
from tastegrid.session import materialise

#: A line on at least this part of a host's pages, and on at least so many, is dropped.
RATIO = 0.08
MIN_PAGES = 4
#: Lines of at least so many words may have a smaller ratio. Short ones recur by chance or habit on honest pages; so many
#: words in a row do not, and what honest repeats there are (quotations, copies of one page) come in small groups, whose
#: part of a host falls as the host grows. A passage on one in a thousand of a host's different pages is the site's own.
LONG_WORDS = 50
LONG_RATIO = 0.001


def _lines(text: str) -> Column:
    return F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1)


def _line_key(line: Column) -> Column:
    """What counts as the same line: its text without spaces at the ends."""
    return F.md5(F.trim(line))


def _is_long(line: Column, long_words: int) -> Column:
    return (F.length(line) >= 2 * long_words - 1) & (F.size(F.split(F.trim(line), r"\s+")) >= long_words)


def boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, long_ratio: float | None = None, long_words: int = LONG_WORDS) -> DataFrame:
    """``host, drop``: for each host the keys of its boilerplate lines, as an array.

    Pages per line and pages per host are counts with map-side combine, so a hot host or line is summed in its tasks
    first. A host's array holds at most (mean lines of a page) / ratio keys, whatever the number of its pages.

    With ``long_ratio``, lines of ``long_words`` words go from that part on as well. For it a line counts once per different
    text and texts are counted, so exact copies of one page do not make its paragraphs boilerplate.
    """
    rows = docs.select(F.col(host_col).alias("host"), _lines(text_col).alias("lines"))
    own = F.array_distinct(F.transform(F.filter("lines", lambda x: F.trim(x) != ""), _line_key))
    pages = rows.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    found = rows.select("host", F.explode(own).alias("key")).groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
    common = found.where(F.col("n") >= min_pages).alias("f").join(pages.alias("p"), F.expr("f.host <=> p.host"))
    common = common.where(F.col("n") >= F.lit(ratio) * F.col("pages")).select("f.host", "key")
    if long_ratio is not None:
        texts = docs.select(F.col(host_col).alias("host"), F.xxhash64(text_col).alias("page"), _lines(text_col).alias("lines"))
        pages = texts.groupBy("host", "page").agg(F.lit(1).alias("one")).groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
        own = F.array_distinct(F.transform(F.filter("lines", lambda x: _is_long(x, long_words)), _line_key))
        found = texts.select("host", "page", F.explode(own).alias("key")).distinct().groupBy("host", "key").agg(F.count(F.lit(1)).alias("n"))
        passages = found.where(F.col("n") >= min_pages).alias("f").join(pages.alias("p"), F.expr("f.host <=> p.host"))
        common = common.union(passages.where(F.col("n") >= F.lit(long_ratio) * F.col("pages")).select("f.host", "key")).distinct()
    return common.groupBy("host").agg(F.collect_list("key").alias("drop"))


def drop_boilerplate(docs: DataFrame, host_col: str = "source", text_col: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, long_ratio: float | None = None) -> DataFrame:
    """``docs`` with the boilerplate lines taken out of the text, plus ``n_lines`` and ``n_dropped`` (longs).

    A line is on a page once, however often it stands there; all its places are dropped. Blank lines stay. A null text
    stays null with no lines; a text that loses all lines becomes empty, its row stays. Null hosts are one host;
    repeated rows are pages of their own. Other columns stay as they are, unless they have the names of the two counts.
    The hosts' arrays are written first, so Spark knows their size when it joins them to the rows by host: it broadcasts
    them if they are small and else splits the rows of a hot host.
    """
    found = materialise(boilerplate(docs, host_col, text_col, ratio, min_pages, long_ratio), "boilerplate")
    rows = boxed(docs, at=F.col(host_col), text=F.col(text_col))
    lines = _lines("text")
    kept = F.when(F.col("drop").isNull(), lines).otherwise(F.filter(lines, lambda x: (F.trim(x) == "") | ~F.array_contains(F.col("drop"), _line_key(x))))
    joined = rows.join(found, F.col("at").eqNullSafe(F.col("host")), "left")
    joined = joined.withColumn("lines", F.when(F.col("text").isNotNull(), lines)).withColumn("kept", F.when(F.col("text").isNotNull(), kept))
    # the size of a null array is -1 or null, by a setting of the session
    n, m = (F.greatest(F.coalesce(F.size(c), F.lit(0)), F.lit(0)) for c in ("lines", "kept"))
    text = F.when(F.col("drop").isNull(), F.col("text")).otherwise(F.array_join("kept", "\n"))
    columns = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    return joined.select(*unboxed(rows, columns, **{text_col: text, "n_lines": n.cast("bigint"), "n_dropped": (n - m).cast("bigint")}))


#: DuckDB's SQL for :func:`drop_boilerplate` over the table ``{docs}``.
SQL = f"""
WITH pages AS (SELECT row_number() OVER () AS page, doc_id, source, text, string_split(text, chr(10)) AS lines FROM {{docs}}),
uses AS (SELECT page, source, unnest(lines) AS line FROM pages),
counted AS (SELECT source, trim(line, ' ') AS line, count(DISTINCT page) AS n FROM uses WHERE trim(line, ' ') <> '' GROUP BY ALL),
hosts AS (SELECT source, count(*) AS pages FROM pages GROUP BY source),
common AS (
  SELECT c.source, list(c.line) AS gone FROM counted c JOIN hosts h ON c.source IS NOT DISTINCT FROM h.source
  WHERE c.n >= {MIN_PAGES} AND c.n >= {RATIO}::DOUBLE * h.pages GROUP BY c.source),
cut AS (
  SELECT p.*, CASE WHEN g.gone IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(g.gone, trim(x, ' '))) END AS kept
  FROM pages p LEFT JOIN common g ON p.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, array_to_string(kept, chr(10)) AS text, coalesce(len(lines), 0)::BIGINT AS n_lines, coalesce(len(lines) - len(kept), 0)::BIGINT AS n_dropped FROM cut
"""
