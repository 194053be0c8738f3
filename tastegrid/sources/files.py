"""Readers and writers of the file formats: headerless TSV, JSON maps, attribute lists, split folders.

Reads declare their schema; nothing is inferred and no line goes through the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tastegrid.functions.ranking import position_in_group

INTERACTIONS = "user long, item long, rating double, ts long"


def _tsv(spark: SparkSession, path: str, schema: str, **options) -> DataFrame:
    return spark.read.schema(schema).options(sep="\t", **options).csv(path)


def write_tsv(df: DataFrame, path: str, header: bool = False) -> None:
    df.write.options(sep="\t", header=header).csv(path)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).withColumnRenamed("value", "line")


# --- interactions and splits --------------------------------------------------------------------------


def read_interactions(spark: SparkSession, path: str, schema: str = INTERACTIONS) -> DataFrame:
    """Headerless user, item, rating, timestamp; a timestamp column without a single value is dropped."""
    rows = _tsv(spark, path, schema)
    return rows.drop("ts") if rows.filter(F.col("ts").isNotNull()).isEmpty() else rows


def read_fixed_split(spark: SparkSession, train: str, test: str, val: str | None = None) -> DataFrame:
    """Two or three files as one table with ``part``."""
    out = None
    for part, path in (("train", train), ("val", val), ("test", test)):
        if path is not None:
            rows = _tsv(spark, path, INTERACTIONS).withColumn("part", F.lit(part))
            out = rows if out is None else out.unionByName(rows)
    return out


def write_split_hierarchy(folds: DataFrame, root: str) -> None:
    """``root/test_fold=t/val_fold=v/part=p/``; the column values are the folders."""
    folds.write.partitionBy("test_fold", "val_fold", "part").options(sep="\t").csv(root)


def read_split_hierarchy(spark: SparkSession, root: str) -> DataFrame:
    """What :func:`write_split_hierarchy` wrote; a fold or part filter prunes folders."""
    return _tsv(spark, root, INTERACTIONS + ", test_fold int, val_fold int, part string")


def read_nested_folders(spark: SparkSession, root: str) -> DataFrame:
    """``root/<test>/test.tsv`` and ``root/<test>/<val>/{train,val}.tsv`` (or ``root/<test>/train.tsv``): fold
    numbers and part come from each row's file name below ``root``."""
    rows = spark.read.schema(INTERACTIONS).options(sep="\t", recursiveFileLookup=True).csv(root)
    top = spark._jvm.org.apache.hadoop.fs.Path(root)
    top = top.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(top).toUri().getRawPath().rstrip("/")
    whole = F.input_file_name()
    path = F.substring(whole, F.locate(f"{top}/", whole) + len(top), F.length(whole))
    part = F.regexp_extract(path, r"/(train|val|test)\.tsv", 1)
    inner = F.regexp_extract(path, r"/(\d+)/(\d+)/(?:train|val|test)\.tsv", 1)
    outer = F.regexp_extract(path, r"/(\d+)/(?:train|val|test)\.tsv", 1)
    two = path.rlike(r"/\d+/\d+/(?:train|val)\.tsv")
    return rows.select(
        *[F.col(c) for c in rows.columns],
        F.when(two, inner).otherwise(outer).cast("int").alias("test_fold"),
        F.when(two, outer).cast("int").alias("val_fold"),
        part.alias("part"),
    )


def read_labelled(spark: SparkSession, path: str, columns: Sequence[str] = ("userID", "itemID", "x_label")) -> DataFrame:
    """The three named columns of a TSV with header; a missing one raises."""
    rows = spark.read.options(sep="\t", header=True, inferSchema=False).csv(path)
    missing = [c for c in columns if c not in rows.columns]
    if missing:
        raise ValueError(f"no column {missing}")
    return rows.select(*[F.col(c).cast("long").alias(n) for c, n in zip(columns, ("user", "item"))], F.col(columns[2]).cast("int").alias("x_label"))


def label_parts(train: DataFrame, val: DataFrame, test: DataFrame) -> DataFrame:
    """(userID, itemID, x_label) with 0, 1, 2 for the parts."""
    out = None
    for label, part in enumerate((train, val, test)):
        rows = part.select(F.col("user").alias("userID"), F.col("item").alias("itemID"), F.lit(label).alias("x_label"))
        out = rows if out is None else out.unionByName(rows)
    return out


def write_labelled(train: DataFrame, val: DataFrame, test: DataFrame, path: str) -> None:
    write_tsv(label_parts(train, val, test), path, header=True)


# --- attributes, triples, chains ----------------------------------------------------------------------


def read_attributes(spark: SparkSession, path: str) -> DataFrame:
    """(item, feature_id) from lines ``item  f1  f2 ...``; a feature counts once per item."""
    parts = F.split("line", "\t")
    feats = F.array_distinct(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))).cast("array<long>"))
    return _lines(spark, path).select(parts[0].cast("long").alias("item"), F.explode(feats).alias("feature_id"))


def read_onehot(spark: SparkSession, path: str) -> DataFrame:
    """(item, feature_id): the positions that hold a 1."""
    parts = F.split("line", "\t")
    cells = _lines(spark, path).select(parts[0].cast("long").alias("item"), F.posexplode(F.slice(parts, 2, F.size(parts) - 1)).alias("feature_id", "v"))
    return cells.filter(F.col("v").cast("int") == 1).select("item", F.col("feature_id").cast("long").alias("feature_id"))


def read_triples(spark: SparkSession, path: str, tabs: bool = True) -> DataFrame:
    """(s, p, o) by tab or by any whitespace, trimmed."""
    parts = F.split(F.trim("line"), "\t" if tabs else r"\s+")
    return _lines(spark, path).select(*[F.trim(parts[i]).alias(c) for i, c in enumerate("spo")])


def read_int_triples(spark: SparkSession, path: str) -> DataFrame:
    t = read_triples(spark, path, tabs=False)
    return t.select(*[F.col(c).cast("long").alias(c) for c in "spo"]).dropDuplicates()


def read_triples_header(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.options(sep="\t", header=True, enforceSchema=False).schema("subject string, predicate string, object string").csv(path).toDF("s", "p", "o")


def read_feature_chains(spark: SparkSession, path: str) -> DataFrame:
    """(feature_id, chain) from ``id  <p1><p2>...<o>``."""
    parts = F.split("line", "\t")
    inside = F.regexp_replace(parts[1], r"^<|>\s*$", "")
    return _lines(spark, path).select(parts[0].cast("long").alias("feature_id"), F.split(inside, "><").alias("chain"))


def read_properties(spark: SparkSession, path: str) -> DataFrame:
    """Lines that do not start with ``#``."""
    return _lines(spark, path).filter(~F.col("line").startswith("#")).select(F.col("line").alias("property"))


def read_clusters(spark: SparkSession, path: str) -> DataFrame:
    return _tsv(spark, path, "id long, cluster long")


# --- JSON maps ----------------------------------------------------------------------------------------


def _json_map(spark: SparkSession, path: str, value: str) -> DataFrame:
    """(key, value) rows of JSON objects whose values are arrays of numbers; an object may fill the whole file, on one line
    or indented, or there may be one on each line.

    The reader ends a row at every closing bracket, so each entry is a row and a large object is split over tasks. What is
    neither an entry nor the braces and commas between entries raises.
    """
    rows = spark.read.option("lineSep", "]").text(path)
    rest = F.regexp_replace("value", r"^[\s{},]+", "")
    entry = r'^"([^"\\]*)"\s*:\s*\[([^\[\]]*)$'
    body = F.from_json(F.concat(F.lit("["), F.regexp_extract(rest, entry, 2), F.lit("]")), value, {"mode": "FAILFAST"})
    broken = F.raise_error(F.concat(F.lit("no JSON entry: "), F.left(rest, F.lit(80))))
    whole = rest.rlike(entry)
    return rows.where(rest != "").select(F.regexp_extract(rest, entry, 1).alias("key"), F.when(whole, body).when(rest != "", broken.cast(value)).alias("value"))


def read_neighbour_json(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """(src, dst) edges of ``{id: [ids]}``, in dense ids ``(item, idx)`` if given."""
    edges = _json_map(spark, path, "array<long>").select(F.col("key").cast("long").alias("src"), F.explode("value").alias("dst"))
    return edges if ids is None else _dense_ends(edges, ids)


def _dense_ends(edges: DataFrame, ids: DataFrame) -> DataFrame:
    for c in ("src", "dst"):
        edges = edges.join(ids.select(F.col("item").alias(c), F.col("idx").alias(f"_{c}")), c)
    rest = [c for c in edges.columns if c not in ("src", "dst", "_src", "_dst")]
    return edges.select(F.col("_src").alias("src"), F.col("_dst").alias("dst"), *rest)


def read_pair_json(spark: SparkSession, path: str, ids: DataFrame | None = None) -> DataFrame:
    """(src, dst, vec) of ``{"a_b": [floats]}`` in the order of the ends."""
    parts = F.split("key", "_")
    edges = _json_map(spark, path, "array<double>").select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst"), F.col("value").alias("vec"))
    edges = edges if ids is None else _dense_ends(edges, ids)
    return edges.orderBy("src", "dst")


def read_word_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(id, pos, token) of ``{id: [tokens]}``."""
    return _json_map(spark, path, "array<long>").select(F.col("key").cast("long").alias("id"), F.posexplode("value").alias("pos", "token"))


# --- embeddings ---------------------------------------------------------------------------------------


def read_embeddings(spark: SparkSession, path: str, ids: DataFrame, id_column: str = "id", vec_column: str = "vec") -> DataFrame:
    """(idx, item, vec) of the items ``(item, idx)`` that have a vector; parquet, two columns read."""
    rows = spark.read.parquet(path).select(F.col(id_column).alias("item"), F.col(vec_column).alias("vec"))
    return rows.join(ids, "item").select("idx", "item", "vec")


def read_interaction_embeddings(interactions: DataFrame, vectors: DataFrame, key: str = "key") -> DataFrame:
    """(user, item, vec) ordered by user and item; the interaction's key column names its vector."""
    return interactions.join(vectors.select(F.col("id").alias(key), "vec"), key).select("user", "item", "vec").orderBy("user", "item")


# --- recommendations and negatives --------------------------------------------------------------------


def read_recs(spark: SparkSession, path: str) -> DataFrame:
    """(user, item, score, rank) of ``user  item  score`` rows, best first."""
    rows = _tsv(spark, path, "user long, item long, score double")
    return position_in_group(rows, ["user"], [F.desc("score"), F.asc("item")], "rank")


def read_rec_folder(spark: SparkSession, root: str) -> DataFrame:
    """All models' lists below a folder in one read; ``model`` is the file's or the sub-folder's name."""
    rows = spark.read.schema("user long, item long, score double").options(sep="\t", recursiveFileLookup=True).csv(root)
    own = F.regexp_extract(F.input_file_name(), r"/([^/]+?)(?:\.tsv)?/part-[^/]*$", 1)
    single = F.regexp_extract(F.input_file_name(), r"/([^/]+?)\.tsv$", 1)
    return rows.withColumn("model", F.when(own != "", own).otherwise(single))


def write_recs(recs: DataFrame, path: str) -> None:
    write_tsv(recs.select("user", "item", "score"), path)


def negative_lines(negatives: DataFrame) -> DataFrame:
    """One line ``(user,)  i1  i2 ...`` per user; the number of negatives per user is a sampling parameter."""
    lists = negatives.groupBy("user").agg(F.sort_array(F.collect_list("item")).alias("items"))
    return lists.select(F.concat(F.lit("("), F.col("user").cast("string"), F.lit(",)\t"), F.array_join(F.col("items").cast("array<string>"), "\t")).alias("line"))


def write_negatives(negatives: DataFrame, path: str) -> None:
    negative_lines(negatives).write.text(path)


def read_fixed_negatives(spark: SparkSession, path: str, items: DataFrame | None = None) -> DataFrame:
    """(user, item); items that are not in the catalogue are dropped."""
    parts = F.split("line", "\t")
    user = F.regexp_extract(parts[0], r"\((\d+),?\)", 1).cast("long")
    rows = _lines(spark, path).select(user.alias("user"), F.explode(F.slice(parts, 2, F.size(parts) - 1)).alias("item"))
    rows = rows.select("user", F.col("item").cast("long").alias("item"))
    return rows if items is None else rows.join(items.select("item").distinct(), "item", "left_semi").select("user", "item")


# --- result files -------------------------------------------------------------------------------------


def wide_topk(recs: DataFrame, k: int) -> DataFrame:
    """(id, top_0, ..., top_k-1)."""
    picks = [F.max(F.when(F.col("rank") == r + 1, F.col("item"))).alias(f"top_{r}") for r in range(k)]
    return recs.groupBy(F.col("user").alias("id")).agg(*picks)


def topk_long(wide: DataFrame) -> DataFrame:
    """(user, rank, item) of a wide top-k table."""
    names = [c for c in wide.columns if c.startswith("top_")]
    long = wide.unpivot(["id"], names, "place", "item").filter(F.col("item").isNotNull())
    rank = F.regexp_extract("place", r"(\d+)", 1).cast("int") + 1
    return long.select(F.col("id").alias("user"), rank.alias("rank"), "item").orderBy("user", "rank")


def write_id_maps(users: DataFrame, items: DataFrame, root: str) -> None:
    users.write.parquet(f"{root}/users")
    items.write.parquet(f"{root}/items")


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, line): ``file`` is the name of the log file or of its folder."""
    own = F.regexp_extract(F.input_file_name(), r"/([^/]+)/[^/]*$", 1)
    return spark.read.option("recursiveFileLookup", True).text(path).select(own.alias("file"), F.col("value").alias("line"))
