"""Feature collections of any size, one file read by many tasks.

The text source cuts files at closing braces and may start a task at any
byte. Whether a piece starts inside a string, and how deep it lies, follows from what
comes before it: sums inside each block of a file, and sums over its blocks,
which are a row each. Pieces up to the end of one element of an array of the
document are one group and are parsed on their own. All of it is DataFrame
functions, so any file system that Spark reads will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.shared import table

PLACE = ["file", "block"]
#: Stands for the array in which a group begins.
OPEN = "_open"


def _balance(text: Column, opened: str, closed: str) -> Column:
    return F.length(F.replace(text, F.lit(closed), F.lit(""))) - F.length(F.replace(text, F.lit(opened), F.lit("")))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """file, block, at, piece and what it adds to the depth of braces and brackets, should it start outside (0) or inside (1) a string."""
    raw = spark.read.option("lineSep", "}").text(path)
    held = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.concat("value", F.lit("}")).alias("piece"))
    # No escape ends at a brace, so none crosses a cut.
    parts = held.withColumn("_parts", F.split(F.regexp_replace("piece", r"\\.", ""), '"'))
    bare = [F.array_join(F.filter("_parts", lambda s, k: k % 2 == 0), "").alias("_o0"), F.array_join(F.filter("_parts", lambda s, k: k % 2 == 1), "").alias("_o1")]
    parts = parts.select("*", ((F.size("_parts") - 1) % 2).alias("odd"), *bare)
    deltas = [_balance(F.col(f"_o{i}"), *marks).alias(f"{name}{i}") for i in (0, 1) for name, marks in (("c", "{}"), ("s", "[]"))]
    return parts.select(*PLACE, "at", "piece", "odd", *deltas)


def before(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with the sum of ``value`` over all that come before a row in its file; no window holds more than a block."""
    in_block, over_blocks = Window.partitionBy(*PLACE).orderBy("at"), Window.partitionBy("file").orderBy("block")
    blocks = rows.groupBy(*PLACE).agg(F.sum(value).alias("_of"))
    blocks = blocks.select(*PLACE, (F.sum("_of").over(over_blocks) - F.col("_of")).alias("_before"))
    return rows.join(blocks, PLACE).withColumn(name, F.sum(value).over(in_block) - F.col(value) + F.col("_before")).drop("_before")


def groups(spark: SparkSession, path: str) -> DataFrame:
    """file, no, block, at, text, closed: the text from the end of one element of an array of the root object to the end of the next; the last group of a file runs to its end."""
    marked = before(table(pieces(spark, path), "pieces"), "odd", "_quotes")
    inside = F.col("_quotes") % 2 == 1
    marked = marked.select(*PLACE, "at", "piece", F.when(inside, F.col("c1")).otherwise(F.col("c0")).alias("c"), F.when(inside, F.col("s1")).otherwise(F.col("s0")).alias("s"), ((F.col("_quotes") + F.col("odd")) % 2 == 0).alias("_bare"))
    deep = before(before(marked, "c", "_c"), "s", "_s")
    deep = deep.select(*PLACE, "at", "piece", (F.col("_c") + F.col("c")).alias("_c"), (F.col("_s") + F.col("s")).alias("_s"), "_bare")
    # Below zero: what follows the root object, such as the end of the last line.
    deep = deep.where("_c >= 0").withColumn("closes", (F.col("_bare") & (F.col("_c") == 1) & (F.col("_s") == 1)).cast("int")).drop("_bare", "_c", "_s")
    numbered = before(deep, "closes", "no")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "piece"))), lambda p: p["piece"]), "")
    first = F.min(F.struct("block", "at"))
    return numbered.groupBy("file", "no").agg(joined.alias("text"), first.alias("_first"), (F.max("closes") == 1).alias("closed")).select("file", "no", "_first.block", "_first.at", "text", "closed")


def documents(spark: SparkSession, path: str) -> DataFrame:
    """The groups of ``groups`` as documents of their own, with the members of their roots."""
    body = F.when(F.col("no") == 0, F.col("text")).otherwise(F.concat(F.lit(f'{{"{OPEN}":['), F.regexp_replace("text", r"^\s*,", "")))
    docs = groups(spark, path).select("file", "no", "block", "at", "closed", F.when(F.col("closed"), F.concat(body, F.lit("]}"))).otherwise(body).alias("doc"))
    return docs.withColumn("keys", F.json_object_keys("doc"))


def document_issues(spark: SparkSession, path: str) -> DataFrame:
    """NOT_FEATURE_COLLECTION for files of another kind and for files that break off; one that lacks only its last brace counts as whole, and Spark lists no file of no bytes."""
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    named = F.coalesce(F.get_json_object("doc", "$.type") == "FeatureCollection", F.lit(False))
    sound = documents(spark, path).groupBy("file").agg(F.bool_or(named).alias("named"), F.bool_and(F.col("keys").isNotNull()).alias("whole"), F.min("closed").alias("all_closed")).where("named AND whole AND NOT all_closed")
    return files.join(sound, "file", "left_anti").select("file", F.lit("ERROR").alias("severity"), F.lit("NOT_FEATURE_COLLECTION").alias("code"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """file, index, feature (JSON text; null if the feature is no object): what ``geojson.read`` gives, by many tasks a file.

    Members of the root may stand in any order, and other arrays of objects among them are passed
    over. An empty file, one that is no object and one without features give no
    rows; of a file that breaks off, the features before its end are given.
    The text of one feature is a row, so a feature must fit into one.
    """
    docs = table(documents(spark, path), "groups")
    # A group in which another array began; there are as many as the root object has arrays of objects.
    turns = docs.where("closed AND (no = 0 OR size(keys) > 1)").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("no", F.element_at("keys", -1).alias("key")))).alias("turns"))
    held = docs.join(turns, "file", "left")
    begun = F.try_element_at(F.filter("turns", lambda t: t["no"] < F.col("no")), F.lit(-1))["key"]
    listed = lambda key: F.coalesce(F.from_json(F.get_json_object("doc", f"$.{key}"), "array<string>"), F.array().cast("array<string>"))
    items = F.concat(F.when(F.coalesce(begun == "features", F.lit(False)), listed(OPEN)).otherwise(F.array().cast("array<string>")), listed("features"))
    counted = before(held.select(*PLACE, "at", items.alias("items")).withColumn("_n", F.size("items")), "_n", "_base")
    each = counted.select("file", "_base", F.posexplode("items").alias("_k", "feature"))
    return each.select("file", (F.col("_base") + F.col("_k")).cast("int").alias("index"), F.when(F.get_json_object("feature", "$.type").isNotNull(), F.col("feature")).alias("feature"))
