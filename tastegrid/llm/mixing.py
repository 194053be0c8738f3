"""Mixing sources to target weights by Sainte-Lague apportionment of equal-token blocks.

A source's target is its weighted share of the mix, at most ``most`` times its own size. The mix is cut into blocks of
``block`` words; each block goes to the source with the highest quotient target / (2 k + 1), k being the blocks it has.
The same rule hands a source's blocks to its shards by their sizes. A shard's documents stand in seeded order as one ring
of words; the shard takes its quota of blocks from a seeded block on, round the ring as often as the quota asks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tastegrid.functions.hashing import md5_int, md5_key
from tastegrid.functions.ranking import dense_index
from tastegrid.llm.registry import WORD, boxed, unboxed
from tastegrid.session import materialise

BLOCK_WORDS = 16
#: A shard has at least so many words on average, and the corpus at most ``MAX_SHARDS`` shards besides one per source.
SHARD_WORDS = 1 << 14
MAX_SHARDS = 1 << 16


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def source_targets(sources: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``sources(source, source_size)`` with ``rank, weight, target`` (double) and ``full`` (the target is the cap).

    Sources are ranked by code point, null last, and take the weights in turn. The mix has ``share`` times all words;
    what a capped source cannot take is shared again among the others by weight until no target is above its cap.
    """
    ranked = dense_index(sources.withColumn("absent", F.col("source").isNull()), ["absent", "source"], "rank").drop("absent")
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = materialise(ranked.withColumn("weight", turn), "sources")
    cap = F.lit(most) * F.col("source_size")
    total = share * (ranked.agg(F.sum("source_size")).first()[0] or 0)
    level, known = 0.0, -1
    while True:
        capped = cap < F.lit(level) * F.col("weight")
        row = ranked.agg(
            F.count_if(capped), F.sum(F.when(capped, cap).otherwise(0.0)), F.sum(F.when(capped, 0).otherwise(F.col("weight")))
        ).first()
        if row[0] == known:
            break
        known = row[0]
        level = (total - (row[1] or 0.0)) / row[2] if row[2] else 0.0
    full = cap <= F.lit(level) * F.col("weight")
    return ranked.withColumn("full", full).withColumn("target", F.when(full, cap).otherwise(F.lit(level) * F.col("weight")))


def _bounds(seats: Column, claimants: Column, votes: Column, total: Column) -> tuple[Column, Column]:
    """Seats that a claimant has for certain, and the most it can have: the quotas at two divisors, one above and one below
    the one that hands out exactly ``seats``, so only about two quotients per claimant are left to rank."""
    high = total / F.greatest(seats - claimants / 2, F.lit(0.5))
    low = total / F.greatest(seats + claimants / 2, F.lit(0.5))
    sure = F.when(seats > claimants / 2, F.greatest(F.floor(votes / high + 0.5) - 1, F.lit(0))).otherwise(0).cast("bigint")
    most = (F.floor(votes / low + 0.5) + 1).cast("bigint")
    return sure, most


def source_quotas(targets: DataFrame, block: int) -> DataFrame:
    """``source, quota``: whole blocks for every source below its cap, by highest quotients over all of them."""
    open_ = targets.where("NOT full AND target > 0").select("source", "rank", "target")
    total, n = open_.agg(F.coalesce(F.sum("target"), F.lit(0.0)), F.count(F.lit(1))).first()
    seats = round(total / block)
    sure, most = _bounds(F.lit(seats), F.lit(n), F.col("target"), F.lit(total))
    bounds = materialise(open_.withColumn("sure", sure).withColumn("most", most), "bounds")
    rest = seats - (bounds.agg(F.sum("sure")).first()[0] or 0)
    claims = bounds.select("source", "rank", F.explode(F.sequence("sure", "most")).alias("k"), "target")
    claims = claims.withColumn("quotient", F.col("target") / (2 * F.col("k") + 1))
    won = dense_index(claims, [F.desc("quotient"), F.asc("rank")], "place").where(F.col("place") < rest)
    won = won.groupBy("rank").agg(F.count(F.lit(1)).alias("won"))
    return bounds.join(won, "rank", "left").select("rank", (F.col("sure") + F.coalesce("won", F.lit(0))).alias("quota"))


def shard_quotas(shards: DataFrame) -> DataFrame:
    """``shards(rank, shard, shard_size, quota)`` with ``blocks``: a source's quota handed to its shards by quotients.

    A source has at most ``MAX_SHARDS`` shards, so the windows over one source are bounded.
    """
    of = Window.partitionBy("rank")
    s = shards.where("quota IS NOT NULL").withColumn("n", F.count(F.lit(1)).over(of)).withColumn("all", F.sum("shard_size").over(of))
    sure, most = _bounds(F.col("quota"), F.col("n"), F.col("shard_size").cast("double"), F.col("all").cast("double"))
    s = s.withColumn("sure", sure).withColumn("most", most).withColumn("rest", F.col("quota") - F.sum("sure").over(of))
    claims = s.select("rank", "shard", "shard_size", "sure", "rest", F.explode(F.sequence("sure", "most")).alias("k"))
    claims = claims.withColumn("quotient", F.col("shard_size") / (2 * F.col("k") + 1))
    place = F.row_number().over(of.orderBy(F.desc("quotient"), "shard", "k"))
    won = claims.withColumn("won", (place <= F.col("rest")).cast("bigint"))
    return won.groupBy("rank", "shard").agg((F.max("sure") + F.sum("won")).alias("blocks"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...] = (3, 1, 2),
    share: float = 1.5,
    most: float = 2.0,
    block: int = BLOCK_WORDS,
    seed: str = "mix",
) -> DataFrame:
    """``doc_id, size, source_size, target, taken, source, shard, blocks`` for every row of ``docs``.

    ``taken`` is the number of words that the mix takes from the row, repeats counted: never above ``most`` times its
    size, for ``most`` of 2 the document at most twice. A null text has size 0 and gives nothing; null sources are one
    source, the last; repeated rows and null ids count as documents of their own; ties in the seeded order are broken by
    id and size. An empty table gives an empty one. Extra columns are ignored. Reruns agree, whatever the partitions.
    """
    sized = materialise(docs.select("doc_id", "source", word_count(F.col("text")).alias("size")), "sizes")
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = materialise(source_targets(sources, weights, share, most), "targets")
    quotas = source_quotas(targets, block)
    shard_words = max(SHARD_WORDS, -(-(targets.agg(F.sum("source_size")).first()[0] or 0) // MAX_SHARDS))
    plan = materialise(targets.join(quotas, "rank", "left").withColumn("shards", F.greatest(F.ceil(F.col("source_size") / shard_words), F.lit(1))), "plan")

    same = sized["source"].eqNullSafe(plan["source"])
    dealt = sized.join(plan, same).select("doc_id", sized["source"], "size", "source_size", "target", "rank", "full", "quota", "shards")
    dealt = dealt.withColumn("shard", md5_int(F.lit(seed), F.lit("shard"), "doc_id") % F.col("shards"))
    shards = dealt.groupBy("rank", "shard").agg(F.sum("size").alias("shard_size"), F.max("quota").alias("quota"))
    shards = materialise(shards, "shards")
    shards = shards.drop("quota").join(shard_quotas(shards), ["rank", "shard"], "left")

    order = Window.partitionBy("rank", "shard").orderBy(md5_key(F.lit(seed), F.lit("order"), "doc_id"), "doc_id", "size")
    end = F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))
    ring = dealt.join(shards, ["rank", "shard"]).withColumn("end", end)
    length, a, b = F.col("shard_size"), F.col("end") - F.col("size"), F.col("end")
    ring = ring.withColumn("take", F.when(F.col("full"), (length * most).cast("bigint")).otherwise(F.least(F.coalesce("blocks", F.lit(0)) * block, (length * most).cast("bigint"))))
    ring = ring.withColumn("turns", F.when(length > 0, F.floor(F.col("take") / length)).otherwise(0)).withColumn("part", F.col("take") - F.col("turns") * length)
    first = block * (md5_int(F.lit(seed), F.lit("start"), "rank", "shard") % F.greatest(F.ceil(length / block), F.lit(1)))
    ring = ring.withColumn("from", first).withColumn("to", F.col("from") + F.col("part"))
    ahead = F.greatest(F.least(b, F.col("to")) - F.greatest(a, F.col("from")), F.lit(0))
    round_ = F.greatest(F.least(b, F.col("to") - length) - a, F.lit(0))
    taken = (F.col("turns") * F.col("size") + ahead + round_).cast("bigint")
    return ring.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "shard", F.coalesce("blocks", F.lit(0)).alias("blocks"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs`` that the mix takes words from, with ``size, source_size, target, taken`` (columns of these
    names in ``docs`` are replaced). A row with a null id or one that is repeated is matched by all that decides it: id,
    source and text's size."""
    new = ["size", "source_size", "target", "taken"]
    plan = mix(docs, **options).where("taken > 0").groupBy("doc_id", "source", "size", "source_size", "target").agg(F.max("taken").alias("taken"))
    rows = boxed(docs, own=F.struct("doc_id", "source", word_count(F.col("text")).alias("size")))
    own = plan.select(F.struct("doc_id", "source", "size").alias("of"), *new)
    found = rows.join(own, F.col("own") == F.col("of"))  # structs are equal if their nulls are
    return found.select(*unboxed(rows, [c for c in docs.columns if c not in new], **{c: F.col(c) for c in new}))


#: The operator's result in DuckDB's SQL: every quotient of every block is ranked, instead of the few in question.
SQL = f"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT source, source_size, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS rank FROM totals),
weighed AS (SELECT *, [3, 1, 2][(rank % 3) + 1] AS weight FROM ranked),
level AS (
  SELECT 0 AS step, 1.5 * (SELECT sum(source_size) FROM weighed)::DOUBLE / (SELECT sum(weight) FROM weighed) AS lv
  UNION ALL
  SELECT step + 1, (1.5 * (SELECT sum(source_size) FROM weighed)::DOUBLE
      - (SELECT coalesce(sum(2.0::DOUBLE * source_size), 0) FROM weighed WHERE 2.0::DOUBLE * source_size < lv * weight))
      / (SELECT sum(weight) FROM weighed WHERE NOT (2.0::DOUBLE * source_size < lv * weight))
  FROM level WHERE step < (SELECT count(*) FROM weighed)),
targets AS (
  SELECT w.*, (2.0::DOUBLE * source_size <= lv * weight) AS is_full, CASE WHEN 2.0::DOUBLE * source_size <= lv * weight THEN 2.0::DOUBLE * source_size ELSE lv * weight END AS target
  FROM weighed w, (SELECT lv FROM level ORDER BY step DESC LIMIT 1)),
free AS (SELECT * FROM targets WHERE NOT is_full AND target > 0),
quotas AS (
  SELECT rank, count(*) AS quota FROM (
    SELECT rank, row_number() OVER (ORDER BY target / (2 * k + 1) DESC, rank) AS place
    FROM free, LATERAL (SELECT unnest(range(0, CAST(floor(target / {BLOCK_WORDS}) + 100 AS BIGINT))) AS k))
  WHERE place <= (SELECT round(sum(target) / {BLOCK_WORDS}) FROM free) GROUP BY rank),
size_of AS (SELECT greatest({SHARD_WORDS}, ceil(sum(source_size) / {MAX_SHARDS})) AS shard_words FROM totals),
dealt AS (
  SELECT d.*, t.source_size, t.target, t.rank, t.is_full,
    ('0x' || substr(md5('mix|shard' || coalesce('|' || doc_id, '')), 1, 8))::BIGINT % greatest(ceil(t.source_size / (SELECT shard_words FROM size_of)), 1)::BIGINT AS shard
  FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
shards AS (SELECT rank, shard, sum(size)::BIGINT AS shard_size FROM dealt GROUP BY rank, shard),
shares AS (
  SELECT rank, shard, count(*) AS blocks FROM (
    SELECT rank, shard, quota, row_number() OVER (PARTITION BY rank ORDER BY shard_size / (2 * k + 1) DESC, shard, k) AS place
    FROM (SELECT s.*, q.quota, sum(shard_size) OVER (PARTITION BY s.rank) AS whole FROM shards s JOIN quotas q USING (rank)) s,
      LATERAL (SELECT unnest(range(0, CAST(quota * shard_size / greatest(whole, 1) + 100 AS BIGINT))) AS k))
  WHERE place <= quota GROUP BY rank, shard),
ring AS (
  SELECT d.*, s.shard_size, coalesce(h.blocks, 0) AS blocks,
    sum(size) OVER (PARTITION BY d.rank, d.shard ORDER BY md5('mix|order' || coalesce('|' || doc_id, '')), doc_id, size ROWS UNBOUNDED PRECEDING) AS stop,
    CASE WHEN is_full THEN 2 * shard_size ELSE least(coalesce(h.blocks, 0) * {BLOCK_WORDS}, 2 * shard_size) END AS take,
    {BLOCK_WORDS} * (('0x' || substr(md5('mix|start|' || d.rank || '|' || d.shard), 1, 8))::BIGINT % greatest(ceil(shard_size / {BLOCK_WORDS}.0), 1)::BIGINT) AS begin
  FROM dealt d JOIN shards s USING (rank, shard) LEFT JOIN shares h USING (rank, shard)),
turned AS (SELECT *, CASE WHEN shard_size > 0 THEN take // shard_size ELSE 0 END AS turns FROM ring)
SELECT doc_id, size, source_size, target,
  (turns * size + greatest(least(stop, begin + take - turns * shard_size) - greatest(stop - size, begin), 0)
    + greatest(least(stop, begin + take - turns * shard_size - shard_size) - (stop - size), 0))::BIGINT AS taken,
  source, shard, blocks::BIGINT AS blocks
FROM turned
"""
