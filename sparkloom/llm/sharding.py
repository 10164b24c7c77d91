"""Sharding by a two-pass external shuffle.

Pass 1 scatters the rows uniformly over memory-sized buckets by a seeded hash of their places in the input, so
that neither copies nor a hot key can fill a bucket. Pass 2 shuffles each bucket by Fisher-Yates under a seed of
its own and writes it; buckets one after another are a uniform random order of all rows. Shards are equal runs
of that order: shard s holds the places from floor(s N / n) to floor((s + 1) N / n), so row counts are at most
one apart.

The buckets are written to the shared folder once, with each row's place in its bucket; the buckets' row counts, summed
up in Spark, then give every row its shard and slot. A lost task is run again over the
same input split, sorts its rows before it shuffles them, and so writes the same bucket.

Defined cases: null text has size 1 and the checksum of no bytes; repeated rows and null doc_ids are rows like any
other; a very long text is a row like any other, and its bucket is as much larger; fewer rows than shards leave shards empty; an empty table gives no rows; extra columns are written along,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded, cut, fresh_path, partitions, table, trimmed

SHARDS = 8
BUCKET_BYTES = 16 << 20
#: Buckets for each shuffle partition at least, so that partitions get nearly equal numbers of rows.
SPREAD = 8
SEED = 7
#: Buckets whose counts are summed up together, before those of all such groups are.
GROUP = 1024
#: Buckets (12 bytes each) that are broadcast with the number of rows before them; more are joined by shuffle.
BROADCAST_ROWS = 500_000


def fisher_yates(n: int, seed: tuple[int, ...]) -> np.ndarray:
    """A uniform order of n rows (numpy's generator shuffles by Fisher-Yates)."""
    order = np.arange(n)
    np.random.default_rng(seed).shuffle(order)
    return order


def write_buckets(docs: DataFrame, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, str]:
    """Writes all rows shuffled bucket by bucket; returns them as (row, bucket, place) and the folder."""
    spark = bounded(docs.sparkSession)
    path = fresh_path(spark, "shards")
    total = docs.agg(F.sum(F.octet_length("text").cast("long") + 1)).first()[0] or 0
    buckets = max(-(-int(total) // bucket_bytes), SPREAD * partitions(spark), 1)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    scattered = docs.select(row, F.monotonically_increasing_id().alias("origin")).withColumn("bucket", F.pmod(F.xxhash64(F.lit(seed), "origin"), F.lit(buckets)).cast("int"))
    schema = T.StructType([T.StructField("row", T.StructType(docs.schema.fields)), T.StructField("bucket", T.IntegerType()), T.StructField("place", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def shuffled() -> pa.Table:
            rows = pa.Table.from_batches(held)
            bucket = rows.column("bucket")[0].as_py()
            n = rows.num_rows
            order = fisher_yates(n, (seed, bucket))
            out = rows.select(["row", "bucket"]).take(pa.array(order))
            return out.append_column("place", pa.array(np.arange(n, dtype=np.int64)))

        for batch in batches:
            bucket = batch.column(batch.schema.get_field_index("bucket")).to_numpy()
            at = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]]).tolist() if len(bucket) else [0]
            for i, j in zip(at[:-1], at[1:], strict=True):
                if held and held[0].column(held[0].schema.get_field_index("bucket"))[0].as_py() != int(bucket[i]):
                    yield from shuffled().to_batches(max_chunksize=2000)
                    held.clear()
                held.append(batch.slice(i, j - i))
        if held:
            yield from shuffled().to_batches(max_chunksize=2000)

    # sorted by origin first: the order in which rows arrive must not matter
    dealt = scattered.repartition("bucket").sortWithinPartitions("bucket", "origin")
    dealt.mapInArrow(trimmed(run), schema).write.parquet(path)
    return spark.read.schema(schema).parquet(path), path


def bucket_starts(written: DataFrame) -> DataFrame:
    """bucket and before: how many rows stand in the buckets before it. One task sums up a number for each ``GROUP`` buckets only."""
    sizes = cut(written.groupBy("bucket").count()).withColumn("part", F.floor(F.col("bucket") / GROUP))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("count").alias("rows")).select("part", F.coalesce(F.sum("rows").over(before.orderBy("part")), F.lit(0)).alias("start"))
    inner = F.coalesce(F.sum("count").over(before.partitionBy("part").orderBy("bucket")), F.lit(0))
    return sizes.select("part", "bucket", inner.alias("inner")).join(parts, "part").select("bucket", (F.col("start") + F.col("inner")).cast("long").alias("before"))


def shard(docs: DataFrame, n_shards: int = SHARDS, seed: int = SEED, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """row (all columns), shard and slot of every row, read back from the written buckets."""
    written, _ = write_buckets(docs, seed, bucket_bytes)
    starts = cut(bucket_starts(written))
    rows = written.count()
    small = starts.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    at = written.join(F.broadcast(starts) if small else starts, "bucket").withColumn("at", F.col("before") + F.col("place"))
    begin = [s * rows // n_shards for s in range(n_shards)]
    found = F.lit(0)
    for s in range(1, n_shards):
        found = F.when(F.col("at") >= begin[s], F.lit(s)).otherwise(found)
    return at.select("row", found.cast("int").alias("shard"), "at").withColumn("slot", F.col("at") - F.element_at(F.array(*[F.lit(b).cast("long") for b in begin]), F.col("shard") + 1)).drop("at")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("row.text"), F.lit(""))
    return shard(table(spark, sf_dir, "documents")).select(
        F.col("row.doc_id").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )
