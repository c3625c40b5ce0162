"""Exact deduplication with streaming keyed state on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import Scratch, settings

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Files of one micro-batch.
FILES_PER_BATCH = 64
#: Bound of the state store's memory on each executor.
STATE_MEMORY_MB = 256


def sha256(text: Column) -> Column:
    """32 bytes over the UTF-8 text."""
    return F.unhex(F.sha2(text, 256))


def _addressed(source: DataFrame, key: str, text: str, digest) -> DataFrame:
    """digest, at (key and content locator) and content of each row."""
    content = F.coalesce(F.col(text), F.lit(""))
    at = F.struct(
        F.col(key).alias("id"),
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
    )
    return source.select(digest(content).alias("digest"), at.alias("at"), content.alias("content"))


def stream_groups(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    key: str,
    text: str,
    state: str,
    out: str,
    digest=sha256,
    files_per_batch: int = FILES_PER_BATCH,
) -> None:
    """Run the new files of ``path`` through the keyed state and append the touched groups to ``out``.

    The state is keyed by digest and never expires. It keeps the largest key seen,
    where that row's content lies (file and row) and the number of rows. It lives
    in RocksDB on the executors' disks and in ``state`` on the shared store, so a
    restarted or later run with the same ``state`` goes on from there. Rows of one
    digest are combined before the shuffle, so copies meet as one row a task.
    """
    path = path.rstrip("/")
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream reads a single file only by a pattern
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(pattern)
    groups = _addressed(source, key, text, digest).groupBy("digest")
    groups = groups.agg(F.max("at").alias("keeper"), F.count(F.lit(1)).alias("n"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    with settings(
        spark,
        spark__sql__streaming__stateStore__providerClass=ROCKSDB,
        spark__sql__streaming__stateStore__rocksdb__allowFAllocate="false",
        spark__sql__streaming__stateStore__rocksdb__boundedMemoryUsage="true",
        spark__sql__streaming__stateStore__rocksdb__maxMemoryUsageMB=str(STATE_MEMORY_MB),
    ):
        writer = groups.writeStream.outputMode("update").option("checkpointLocation", state)
        writer.trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()


def _checked(hits: DataFrame, scratch: Scratch) -> DataFrame | None:
    """Groups (digest, content, keeper, n) of digests that stand for more than one text; None without any.

    Every hit's full content is compared with the content that the group's locator names.
    """
    kept = hits.where("at <=> keeper").select("digest", F.col("content").alias("kept"))
    # Nothing after the join needs a digest's rows together, so Spark can split one with very many copies.
    differing = scratch.table(hits.join(kept, "digest").where("content != kept").select("digest"), "differing")
    if not differing.take(1):
        return None
    return (
        hits.join(differing, "digest", "left_semi")
        .groupBy("digest", "content")
        .agg(F.max("at").alias("keeper"), F.count(F.lit(1)).alias("n"))
    )


def exact_dedup(
    spark: SparkSession,
    path: str,
    key: str = "doc_id",
    text: str = "text",
    digest=sha256,
    files_per_batch: int = FILES_PER_BATCH,
) -> DataFrame:
    """(key, keep_id, group_size, kept, text_sha256) of every row of the Parquet table at ``path``.

    Of rows with equal text the one with the largest key stays. A null text equals
    the empty one; nothing else is normalised. A null key is smaller than any
    other; of rows with equal key and text the last in file order stays, so
    exactly one row of a group is kept. An empty table gives no rows; other
    columns play no part, whatever their names.
    """
    scratch = Scratch(spark, "exact-dedup")
    table = spark.read.parquet(path)
    schema = table.select(key, text).schema
    scratch.table(spark.createDataFrame([], _group_schema(schema[key].dataType)), "groups/batch=-1")
    stream_groups(
        spark, path, schema, key, text, scratch.path("state"), scratch.path("groups"), digest, files_per_batch
    )
    # A digest's state only grows, so its largest key and count are the last ones.
    touched = scratch.read("groups", _group_schema(schema[key].dataType))
    groups = touched.groupBy("digest").agg(F.max("keeper").alias("keeper"), F.max("n").alias("n"))
    groups = scratch.table(groups, "final")
    scratch.drop("state", "groups")

    rows = _addressed(spark.read.schema(schema).parquet(path), key, text, digest)
    # The filter over digests with a hit keeps the other texts out of the shuffle.
    with settings(
        spark,
        spark__sql__optimizer__runtime__bloomFilter__enabled="true",
        spark__sql__optimizer__runtime__bloomFilter__applicationSideScanSizeThreshold="0",
        spark__sql__optimizer__runtime__bloomFilter__creationSideThreshold="1g",
    ):
        hits = scratch.table(rows.join(groups.where("n > 1"), "digest"), "hits")
        split = _checked(hits, scratch)
        if split is not None:
            split = scratch.table(split, "split")
    members = rows.select("digest", "at", F.sha2("content", 256).alias("sha")).join(groups, "digest")
    if split is not None:
        alike = split.select("digest").distinct()
        apart = hits.drop("keeper", "n").join(split, ["digest", "content"])
        apart = apart.select("digest", "at", F.sha2("content", 256).alias("sha"), "keeper", "n")
        members = members.join(alike, "digest", "left_anti").unionByName(apart)
    else:
        scratch.drop("hits", "differing")
    return members.select(
        F.col("at.id").alias(key),
        F.col("keeper.id").alias("keep_id"),
        F.col("n").alias("group_size"),
        F.col("at").eqNullSafe(F.col("keeper")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def _group_schema(key_type: T.DataType) -> T.StructType:
    keeper = T.StructType(
        [T.StructField("id", key_type), T.StructField("file", T.StringType()), T.StructField("row", T.LongType())]
    )
    return T.StructType(
        [T.StructField("digest", T.BinaryType()), T.StructField("keeper", keeper), T.StructField("n", T.LongType())]
    )
