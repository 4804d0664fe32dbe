"""Content-addressed storage: identity, idempotent inserts, missing and upserted rows, references."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Rows to insert, once per key, that aren't there yet."""
    return incoming.dropDuplicates(keys).join(existing.select(*keys).distinct(), keys, "left_anti")


def upsert(existing: DataFrame, incoming: DataFrame, keys: list[str], version: str) -> DataFrame:
    """Both together with the latest version of each key."""
    both = existing.unionByName(incoming)
    w = Window.partitionBy(*keys).orderBy(F.desc(version))
    return both.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def missing_embeddings(chunks: DataFrame, embeddings: DataFrame, model: str) -> DataFrame:
    """Chunks without an embedding of their content by the model."""
    return chunks.withColumn("model_name", F.lit(model)).join(embeddings, ["chunk_id", "model_name", "content_sha256"], "left_anti")


def broken_references(links: DataFrame, blocks: DataFrame, chunks: DataFrame) -> DataFrame:
    """chunk_id, missing: sorted ids of blocks that aren't in the chunk's document."""
    own = links.join(chunks.select("chunk_id", "document_id"), "chunk_id")
    return own.join(blocks.select("block_id", "document_id"), ["block_id", "document_id"], "left_anti").groupBy("chunk_id").agg(F.array_sort(F.collect_set("block_id")).alias("missing"))


def cascade_delete(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    return child.join(gone.select(key).distinct(), key, "left_anti")


def linked(chunks: DataFrame) -> DataFrame:
    """chunk_id with the ids before and after it in its document."""
    w = Window.partitionBy("document_id").orderBy("sequence_index", "chunk_id")
    return chunks.select("chunk_id", F.lag("chunk_id").over(w).alias("previous_chunk_id"), F.lead("chunk_id").over(w).alias("next_chunk_id"))


def inserted(incoming: DataFrame, existing: DataFrame, keys: list[str], ident: str) -> DataFrame:
    """keys, ident, created: the row that each incoming key leads to, the one that is there or the first new one."""
    there = existing.groupBy(*keys).agg(F.min(ident).alias("_old"))
    return incoming.groupBy(*keys).agg(F.min(ident).alias("_new")).join(there, keys, "left").select(*keys, F.coalesce("_old", "_new").alias(ident), F.col("_old").isNull().alias("created"))


def set_null(child: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """child with its reference cleared where the row it names is gone."""
    g = gone.select(F.col(key)).distinct().withColumn("_gone", F.lit(True))
    return child.join(g, key, "left").withColumn(key, F.when(F.col("_gone").isNull(), F.col(key))).drop("_gone").select(*child.columns)


def batches(rows: DataFrame, by: list[str], order: list[str], size: int) -> DataFrame:
    """rows with ``batch``: so many at once, in their order, within each group."""
    if not 1 <= size <= 128:
        raise ValueError("a batch has 1 to 128 rows")
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return rows.withColumn("batch", F.floor((n - 1) / size).cast("int"))


def recent_first(rows: DataFrame, key: str, ident: str) -> DataFrame:
    """rows with ``place``: a key's rows by created_at, the latest first, then by id."""
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("created_at"), ident)))


def publish(spark: SparkSession, tables: dict[str, DataFrame], path: str) -> str:
    """Writes tables as one: all to a version of their own, and only then the name of the version; returns the version's folder.

    A reader that goes by ``current`` sees all tables of a version or none.
    """
    version = f"{path.rstrip('/')}/v-{uuid.uuid4().hex}"
    for name, df in tables.items():
        df.write.parquet(f"{version}/{name}")
    spark.createDataFrame([(version,)], "version string").coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/current")
    return version


def published(spark: SparkSession, path: str, name: str) -> DataFrame:
    version = spark.read.schema("version string").json(f"{path.rstrip('/')}/current").first()["version"]
    return spark.read.parquet(f"{version}/{name}")


def numbered(passages: DataFrame) -> DataFrame:
    """chunk_id, passage_id: P1, P2 ... within each document, in order."""
    n = F.row_number().over(Window.partitionBy("document_id").orderBy("sequence_index", "chunk_id"))
    return passages.select("chunk_id", F.concat(F.lit("P"), n.cast("string")).alias("passage_id"))


def zipped(left: DataFrame, right: DataFrame, by: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """Rows of two tables side by side by their place in each group; what the longer one has more is left out."""
    place = lambda df, order: df.withColumn("_place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
    return place(left, left_order).join(place(right, right_order), [*by, "_place"]).drop("_place")
