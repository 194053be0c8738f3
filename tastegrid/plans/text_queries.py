"""Queries on keyword strings and review texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from tastegrid.operators import text as tx
from tastegrid.plans import fixtures as fx
from tastegrid.plans.catalog import longs, query

LABELS = ["Category", "Pet Type", "Purpose"]
_TIDY = r"""regexp_replace(regexp_replace(regexp_replace({0}, '\s*,\s*', ', ', 'g'), '\s+', ' ', 'g'), '^[ ,]+|[ ,]+$', '', 'g')"""
_DOTS = r"regexp_replace(keywords, '\.+$', '')"
_LABELLED = _TIDY.format(
    r"regexp_replace(regexp_replace(" + _DOTS + r", '(?i)\[(Category|Pet Type|Purpose)\]\s*\{([^}]+)\}', '\2', 'g'), '\[\]\s*\{([^}]+)\}', '\1', 'g')")
_CLEANED = f"cleaned AS (SELECT name, {_LABELLED} AS keywords FROM keywords WHERE trim(keywords) <> '')"


@query("tx01_clean_keywords", f"WITH {_CLEANED} SELECT name, keywords FROM cleaned")
def tx01(spark, sf):
    return tx.clean_keywords(fx.keywords(spark, sf), LABELS)


@query("tx02_clean_column", "SELECT name, " + _TIDY.format(r"regexp_replace(" + _DOTS + r", '\[[^\]]*\]\s*\{([^}]+)\}', '\1', 'g')") + " AS keywords FROM keywords")
def tx02(spark, sf):
    return fx.keywords(spark, sf).withColumn("keywords", tx.clean_column("keywords"))


@query("tx03_extract_braced", r"""WITH g AS (SELECT name, regexp_extract_all(keywords, '\{([^}]+)\}', 1) AS g FROM keywords)
    SELECT name, array_to_string(list_transform(g, lambda x: trim(split_part(trim(split_part(x, ',', 1)), '/', 1))), '|') AS words FROM g""")
def tx03(spark, sf):
    return fx.keywords(spark, sf).select("name", F.array_join(tx.extract_braced("keywords"), "|").alias("words"))


@query("tx04_parse_labelled_entry", r"""WITH e AS (SELECT name, unnest(regexp_extract_all(keywords, '\[[^\]]*\]\s*\{[^}]*\}')) AS e FROM keywords),
    m AS (SELECT name, e, lower(regexp_extract(e, '^\[(\w+)\]\s*\{([^}]+)\}', 1)) AS l FROM e)
    SELECT name, e AS entry, CASE WHEN l IN ('category', 'pet type', 'purpose') THEN l WHEN l <> '' OR regexp_matches(e, '^\[([^\]]+)\]') THEN 'Keywords' END AS label,
      CASE WHEN l <> '' THEN trim(regexp_extract(e, '^\[(\w+)\]\s*\{([^}]+)\}', 2)) WHEN regexp_matches(e, '^\[([^\]]+)\]') THEN trim(regexp_extract(e, '^\[([^\]]+)\]', 1)) END AS value FROM m""")
def tx04(spark, sf):
    entries = fx.keywords(spark, sf).select("name", F.explode(F.regexp_extract_all("keywords", F.lit(r"(\[[^\]]*\]\s*\{[^}]*\})"), F.lit(1))).alias("entry"))
    return entries.withColumn("p", tx.parse_labelled_entry("entry", LABELS)).select("name", "entry", "p.label", "p.value")


# Lemmas: the first letter of a brand number is dropped, standing in for a word form table.
_LEMMAS = "lemmas AS (SELECT DISTINCT lower(p_brand) AS form, regexp_replace(lower(p_brand), '#([0-9])[0-9]$', '#\\1') AS lemma FROM part)"
_WORDS = _CLEANED + r""", flat AS (SELECT name, string_split(regexp_replace(keywords, '\[(.*?)\]', '\1', 'g'), ',') AS w FROM cleaned),
    long AS (SELECT name, p, trim(lower(w[p])) AS word FROM (SELECT name, w, unnest(range(1, len(w) + 1)) AS p FROM flat) WHERE trim(w[p]) <> ''),
    """ + _LEMMAS + """, words AS MATERIALIZED (SELECT name, row_number() OVER (PARTITION BY name ORDER BY p) AS pos, coalesce(lemma, word) AS word FROM long LEFT JOIN lemmas ON form = word)"""


def _lemmas(spark, sf):
    form = F.lower("p_brand")
    return fx.parts(spark, sf).select(form.alias("form"), F.regexp_replace(form, "#([0-9])[0-9]$", "#$1").alias("lemma")).distinct()


def _words(spark, sf):
    return tx.normalise_keywords(tx.clean_keywords(fx.keywords(spark, sf), LABELS), _lemmas(spark, sf))


@query("tx05_normalise_keywords", f"WITH {_WORDS} SELECT name, string_agg(word, ', ' ORDER BY pos) AS words FROM words GROUP BY name")
def tx05(spark, sf):
    return _words(spark, sf).select("name", F.array_join("words", ", ").alias("words"))


_COUNTS = f"{_WORDS}, counts AS (SELECT word, count(*) AS count FROM words GROUP BY word)"


@query("tx06_keyword_counts", f"WITH {_COUNTS} SELECT word, count FROM counts")
def tx06(spark, sf):
    return tx.keyword_counts(_words(spark, sf))


_REPS = f"""{_COUNTS}, clusters AS (SELECT word, substr(word, 1, 2) AS cluster FROM counts),
    best AS (SELECT cluster, word AS rep FROM (SELECT c.cluster, c.word, row_number() OVER (PARTITION BY cluster ORDER BY count DESC, c.word) AS r FROM clusters c JOIN counts USING (word)) WHERE r = 1),
    mapping AS (SELECT word, rep FROM clusters JOIN best USING (cluster))"""


def _mapping(spark, sf):
    counts = tx.keyword_counts(_words(spark, sf))
    clusters = counts.select("word", F.substring("word", 1, 2).alias("cluster"))
    return tx.cluster_representative(clusters, counts)


@query("tx07_cluster_representative", f"WITH {_REPS} SELECT word, rep AS representative FROM mapping")
def tx07(spark, sf):
    return _mapping(spark, sf)


@query("tx08_frequency_threshold", f"WITH {_COUNTS} SELECT word, count FROM counts WHERE count >= 100")
def tx08(spark, sf):
    return tx.frequency_threshold(tx.keyword_counts(_words(spark, sf)), 100)


_MAPPED = f"{_REPS}, mapped AS MATERIALIZED (SELECT name, pos, coalesce(rep, word) AS word FROM words LEFT JOIN mapping USING (word))"


@query("tx09_apply_mapping", f"WITH {_MAPPED} SELECT name, string_agg(word, ', ' ORDER BY pos) AS words FROM mapped GROUP BY name")
def tx09(spark, sf):
    return tx.apply_mapping(_words(spark, sf), _mapping(spark, sf)).select("name", F.array_join("words", ", ").alias("words"))


@query("tx09_apply_mapping_distinct", f"""WITH {_MAPPED}, f AS (SELECT name, word, min(pos) AS pos FROM mapped GROUP BY name, word)
    SELECT name, string_agg(word, ', ' ORDER BY pos) AS words FROM f GROUP BY name""")
def tx09d(spark, sf):
    return tx.apply_mapping(_words(spark, sf), _mapping(spark, sf), distinct=True).select("name", F.array_join("words", ", ").alias("words"))


_TOP = f"""{_WORDS}, labelled AS (SELECT w.name, label, word FROM words w JOIN (VALUES (1, 'Category'), (2, 'Pet Type'), (3, 'Purpose')) l(pos, label) USING (pos)),
    top AS MATERIALIZED (SELECT label, word, count, rank FROM (SELECT label, word, count(*) AS count, row_number() OVER (PARTITION BY label ORDER BY count(*) DESC, word) AS rank FROM labelled GROUP BY label, word) WHERE rank <= 4),
    every AS (SELECT n.name, l.label, x.word FROM (SELECT DISTINCT name FROM words) n CROSS JOIN (VALUES ('Category'), ('Pet Type'), ('Purpose')) l(label) LEFT JOIN labelled x ON x.name = n.name AND x.label = l.label),
    assigned AS MATERIALIZED (SELECT e.name, e.label, coalesce(t.word, 'Other') AS word FROM every e LEFT JOIN top t ON t.label = e.label AND t.word = e.word)"""


def _top(spark, sf):
    return tx.count_by_category(_words(spark, sf), LABELS, 4)


def _assigned(spark, sf):
    return tx.assign_categories(_words(spark, sf), _top(spark, sf), LABELS)


@query("tx10_count_by_category", f"WITH {_TOP} SELECT label, word, count, rank::INTEGER AS rank FROM top")
def tx10(spark, sf):
    return _top(spark, sf)


@query("tx11_assign_categories", f"WITH {_TOP} SELECT name, label, word FROM assigned")
def tx11(spark, sf):
    return _assigned(spark, sf)


@query("tx12_other_histogram", f"""WITH {_TOP}, p AS (SELECT name, count(*) FILTER (word = 'Other') AS others FROM assigned GROUP BY name)
    SELECT b.others, count(p.name) AS rows FROM (SELECT unnest(range(4)) AS others) b LEFT JOIN p USING (others) GROUP BY b.others""")
def tx12(spark, sf):
    return tx.other_histogram(_assigned(spark, sf), LABELS)


@query("tx12_others_per_label", f"WITH {_TOP} SELECT label, count(*) FILTER (word = 'Other') AS others FROM assigned GROUP BY label")
def tx12_labels(spark, sf):
    return tx.others_per_label(_assigned(spark, sf))


@query("tx13_one_hot_categories", f"""WITH {_TOP}, cats AS (SELECT label, lower(word) AS c, 0 AS last FROM top UNION ALL SELECT DISTINCT label, 'other', 1 FROM top)
    SELECT replace(a.name, '.jpg', '') AS name, a.label, string_agg(c, ' ' ORDER BY last, c) AS categories, string_agg(CASE WHEN lower(a.word) = c THEN '1' ELSE '0' END, ' ' ORDER BY last, c) AS flags
    FROM assigned a JOIN cats USING (label) GROUP BY a.name, a.label, a.word""")
def tx13(spark, sf):
    hot = tx.one_hot_categories(_assigned(spark, sf), _top(spark, sf))
    return hot.select("name", "label", F.array_join("categories", " ").alias("categories"), F.array_join(F.col("flags").cast("array<string>"), " ").alias("flags"))


@query("tx14_clean_review_text")
def tx14(spark, sf):
    """The patterns look around, which the checking SQL cannot; the tests compare with hand-made results."""
    return fx.reviews(spark, sf).select("id", tx.clean_review_text("text").alias("text"))


@query("tx15_split_sentences", """WITH s AS (SELECT id, string_split(text, '.') AS s FROM reviews), e AS (SELECT id, s, unnest(range(1, len(s) + 1)) AS p FROM s)
    SELECT id, p - 1 AS pos, s[p] || CASE WHEN p < len(s) THEN '.' ELSE '' END AS sentence FROM e""")
def tx15(spark, sf):
    pieces = fx.reviews(spark, sf).select("id", F.posexplode(tx.split_sentences("text")).alias("pos", "sentence"))
    return longs(pieces, "pos")


@query("tx16_text_by_id", "SELECT conv_id || '__' || turn AS id, text FROM conversations UNION ALL SELECT id::VARCHAR, text FROM reviews")
def tx16(spark, sf):
    turns = tx.text_by_id(fx.table(spark, sf, "conversations"), ["conv_id", "turn"], "text")
    return turns.unionByName(tx.text_by_id(fx.reviews(spark, sf), ["id"], "text"))
