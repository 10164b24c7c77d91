"""Shared helpers: table access, the shared folder, and id columns."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CHECKPOINT_KEY = "spark.checkpoint.dir"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder serves if the driver and its tasks are one process; otherwise there is
    an error, as executors could not see a folder of the driver's.
    """
    where = spark.conf.get(CHECKPOINT_KEY, None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError(f"set {CHECKPOINT_KEY} to a folder that the driver and all executors share")
        where = f"file://{tempfile.mkdtemp(prefix='sparkloom-')}"
        spark.conf.set(CHECKPOINT_KEY, where)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(where)
    return where


def fresh_path(spark: SparkSession, what: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def open_store(path: str):
    """The file system of a path in the shared folder, and the path in it; for tasks and the driver alike."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and cut the lineage; survives lost executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Bytes of rows that one Arrow batch may hold on its way to and from Python, however long the texts are.
BATCH_BYTES = 8 << 20


def bounded(spark: SparkSession) -> SparkSession:
    """Bound Arrow batches by bytes; by rows alone, a batch of long texts could fill a worker's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` that gives the memory of its task back to the system at the end, as workers wait for further tasks."""

    def whole(batches: Iterator) -> Iterator:
        import ctypes

        import pyarrow as pa

        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return whole


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def with_text(docs: DataFrame, text: str = "text") -> DataFrame:
    """doc_id and text only; a null text is the empty text."""
    bounded(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))


def free_name(taken, wanted: str) -> str:
    """A column name that clashes with none of ``taken`` (Spark ignores case in names)."""
    names = {c.lower() for c in taken}
    while wanted.lower() in names:
        wanted = f"_{wanted}"
    return wanted


#: Keys with more than one in so many rows are heavy; there are fewer of them than this.
HEAVY = 1000


def join_named(rows: DataFrame, named: DataFrame, key: str, weight: str, broadcast_rows: int) -> DataFrame:
    """Rows left-joined by a text key with ``named``, which has a row for each key and in ``weight`` how many rows have it.

    Up to ``broadcast_rows`` keys are broadcast. Of more, only the heavy ones are; the others are joined by shuffle,
    where none has more than one in ``HEAVY`` rows, and rows of heavy keys are dealt out evenly.
    """
    plain = named.drop(weight)
    if named.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return rows.join(F.broadcast(plain), key, "left")
    total = named.agg(F.sum(weight)).first()[0]
    heavy = F.col(weight) * HEAVY > total
    values = [c for c in plain.columns if c != key]
    light, top, own = (free_name([*rows.columns, *named.columns], c) for c in ("light_values", "heavy_values", "own_key"))
    packed = F.struct(*values)
    found = rows.join(F.broadcast(named.where(heavy).select(key, packed.alias(top))), key, "left")
    alone = F.concat(F.lit("\0"), F.monotonically_increasing_id().cast("string"))
    found = found.withColumn(own, F.when(F.col(top).isNull(), F.col(key)).otherwise(alone))
    found = found.join(named.where(~heavy).select(F.col(key).alias(own), packed.alias(light)), own, "left")
    return found.select(*[F.col(f"`{c}`") for c in rows.columns], *[F.coalesce(F.col(top)[v], F.col(light)[v]).alias(v) for v in values])
