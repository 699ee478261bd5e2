"""Connected components by alternating star contractions; every round is a few shuffles of the edges.

Edges that are few, by a count, are gone through on the driver instead: rounds of jobs over next to no data
cost it more than the edges do.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


#: Edges that the driver takes, at most; 16 bytes each.
FEW = 100_000


def _smallest(edges: list[tuple[int, int]]) -> pa.Table:
    parent: dict[int, int] = {}

    def root(i: int) -> int:
        top = i
        while (up := parent.setdefault(top, top)) != top:
            top = up
        while i != top:
            parent[i], i = top, parent[i]
        return top

    for u, v in edges:
        low, high = sorted((root(u), root(v)))
        parent[high] = low
    ids = list(parent)
    return pa.table({"id": pa.array(ids, pa.int64()), "component": pa.array([root(i) for i in ids], pa.int64())})


def components(links: DataFrame, few: int = FEW) -> DataFrame:
    """links (a, b: bigint, undirected) to (id, component): each id of a link with the smallest id reachable.

    Minima are partial aggregates, so a node that very many links share is no hot group; edges never
    exceed the links. Null ends and loops are ignored.
    """
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = cut(edges)
    some = edges.limit(few + 1).toArrow()
    if some.num_rows <= few:
        return links.sparkSession.createDataFrame(_smallest(list(zip(*(c.to_pylist() for c in some.columns), strict=True))), "id bigint, component bigint")
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = both.join(low, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct())
        new = _state(edges)
        if new == state:
            break
        state = new
    roots = edges.select(F.col("v").alias("id")).distinct().withColumn("component", F.col("id"))
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(roots)
