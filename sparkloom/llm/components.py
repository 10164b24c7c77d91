"""Connected components of an edge table.

Up to ``ONE_TASK`` edges (16 bytes each) are joined by union-find in one executor task, which spares many rounds
of shuffling. More edges go by alternating stars: every vertex links its larger neighbours to its smallest
neighbour, then its smaller ones, until nothing changes; each round is two joins' worth of aggregation over the
edges and cuts its lineage in the shared folder. Links are never gathered on the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

ONE_TASK = 500_000


def _union_find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            p, q = root(a), root(b)
            up[max(p, q)] = min(p, q)
    if up:
        yield pa.RecordBatch.from_arrays([pa.array(list(up), pa.int64()), pa.array([root(x) for x in list(up)], pa.int64())], names=["vertex", "component"])


def _least(edges: DataFrame) -> DataFrame:
    """For each vertex the smallest of itself and its neighbours."""
    return edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def components(edges: DataFrame, a: str = "a", b: str = "b", one_task: int = ONE_TASK) -> DataFrame:
    """vertex and component (the smallest vertex that can be reached) for each vertex of an edge table (a, b).

    Null ends and loops are ignored; repeated edges count once; an empty table gives no rows.
    """
    e = edges.where(f"{a} IS NOT NULL AND {b} IS NOT NULL AND {a} <> {b}").select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v"))
    if e.limit(one_task + 1).count() <= one_task:
        return e.repartition(1).mapInArrow(_union_find, "vertex long, component long")
    e = cut(e.distinct())
    while True:
        # large star: larger neighbours go to the smallest
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: smaller neighbours and the vertex itself go to the smallest of them
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = cut(small)
        changed = new.exceptAll(e).limit(1).count() + e.exceptAll(new).limit(1).count()
        e = new
        if not changed:
            break
    return e.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("vertex"), F.col("v").alias("component")).distinct())
