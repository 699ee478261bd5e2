"""Near-duplicate vectors by PCA-ordered tiled comparison.

Equal vectors collapse first, and only those of one length are compared. They are rotated to principal axes, sorted by the leading one
into blocks of bounded size, and blocks are compared pairwise; a vector goes only to those blocks whose bounding box
on the leading axes is near enough. Lengths of few vectors make one block each. Within a pair of blocks, tiles accumulate the leading
dimensions; the product of the two suffix norms bounds what the remaining dimensions can add
(Cauchy-Schwarz), and a pair is dropped as soon as it cannot reach the threshold. What is left is
decided by the full cosine in double precision. Tasks return counts and spanning edges, never
pairs, so that a dense group costs no more than its vectors.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import cut, small_enough
from quillon.llm.components import components

#: Bytes of a block as doubles, at most. A length of more vectors than LEAST makes BLOCKS blocks or more, so that there are tasks to go round.
BLOCK_BYTES, BLOCKS, LEAST = 16 << 20, 4, 4096
#: Vectors of a tile, dimensions of a step, leading axes of a box.
TILE, LEAD, BOX = 1024, 16, 16
#: Slack of the pruning bounds against rounding; the decision itself has none.
EPS = 1e-9


def _unit(lists: pa.Array) -> np.ndarray:
    x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _merge(label: np.ndarray, p: np.ndarray, q: np.ndarray) -> None:
    """Unites the sets of p[k] and q[k]: label[i] is the smallest index of i's set, before and after."""
    while True:
        lp, lq = label[p], label[q]
        if np.array_equal(lp, lq):
            return
        m = np.minimum(lp, lq)
        np.minimum.at(label, lp, m)
        np.minimum.at(label, lq, m)
        while not np.array_equal(label, up := label[label]):
            label[:] = up


def compare(x: np.ndarray, y: np.ndarray, rx: np.ndarray, ry: np.ndarray, threshold: float, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (x, y) of cosine >= threshold, tile by tile; x, y: unit rows, rx, ry: the same on principal axes; same: i < j only."""
    d = x.shape[1]
    steps = list(range(0, d, LEAD)) + [d]
    tail = lambda r: [np.sqrt((r[:, s:] ** 2).sum(axis=1)) for s in steps[1:]]
    tx, ty = tail(rx), tail(ry)
    for i in range(0, len(x), TILE):
        for j in range(i if same else 0, len(y), TILE):
            a, b = slice(i, i + TILE), slice(j, j + TILE)
            part = rx[a, : steps[1]] @ ry[b, : steps[1]].T
            p, q = np.nonzero(part + tx[0][a][:, None] * ty[0][b] >= threshold - EPS)
            if same and i == j:
                p, q = p[p < q], q[p < q]
            v = part[p, q]
            for k in range(1, len(steps) - 1):
                if not len(p):
                    break
                s, e = steps[k], steps[k + 1]
                for c in range(0, len(p), 1 << 16):
                    z = slice(c, c + (1 << 16))
                    v[z] += np.einsum("ij,ij->i", rx[i + p[z], s:e], ry[j + q[z], s:e])
                on = v + tx[k][i + p] * ty[k][j + q] >= threshold - EPS
                p, q, v = p[on], q[on], v[on]
            p, q = p + i, q + j
            ok = np.concatenate([np.einsum("ij,ij->i", x[p[c : c + (1 << 16)]], y[q[c : c + (1 << 16)]]) >= threshold for c in range(0, len(p), 1 << 16)] or [np.zeros(0, bool)])
            if ok.any():
                yield p[ok], q[ok]


FOUND = "id bigint, n bigint, root bigint"


def _axes(second: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.linalg.eigh(second)[1][:, ::-1])


def _links(rep: np.ndarray, mult: np.ndarray, unit: np.ndarray, turned: np.ndarray, a: np.ndarray, b: np.ndarray, threshold: float) -> pa.Table:
    """Of the pairs of rows a and b (all pairs of a, if they are the same): linked ids, how many vectors each is linked with, and their spanning edges."""
    n, label = np.zeros(len(rep), np.int64), np.arange(len(rep))
    for p, q in compare(unit[a], unit[b], turned[a], turned[b], threshold, a is b):
        p, q = a[p], b[q]
        np.add.at(n, p, mult[q])
        np.add.at(n, q, mult[p])
        _merge(label, p, q)
    on = n > 0
    return pa.table({"id": pa.array(rep[on]), "n": pa.array(n[on]), "root": pa.array(rep[label[on]])})


def _few(threshold: float):
    """Compares all vectors of a length that makes one block."""

    def run(key, t):
        t = t.combine_chunks()
        unit = _unit(_list(t["v"]))
        a = np.arange(len(unit))
        return _links(t["rep"].to_numpy(), t["mult"].to_numpy(), unit, unit @ _axes(unit.T @ unit), a, a, threshold)

    return run


def _list(column) -> pa.Array:
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def _many(classes: DataFrame, d: int, n: int, threshold: float, block: int) -> DataFrame:
    """FOUND for the n vectors of length d."""
    kind = classes.schema["v"].dataType.simpleString()

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            for c in range(0, len(batch), 4096):
                x = _unit(batch.column(0).slice(c, 4096))
                total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array([total.reshape(-1).tolist()], pa.list_(pa.float64()))], names=["m"])

    # d * d sums, whatever the number of vectors
    m = classes.select("v").mapInArrow(moments, "m array<double>").select(F.posexplode("m").alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x")).toPandas()
    second = np.zeros(d * d)
    second[m["i"].to_numpy()] = m["x"].to_numpy()
    axes = _axes(second.reshape(d, d))
    box = min(BOX, d)

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            y = (_unit(batch.column(2)) @ axes)[:, :box] if len(batch) else np.zeros((0, box))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.FixedSizeListArray.from_arrays(pa.array(y.reshape(-1)), box).cast(pa.list_(pa.float64()))], names=["rep", "mult", "v", "y"])

    blocks = max(BLOCKS, math.ceil(n / block))
    placed = classes.select("rep", "mult", "v").mapInArrow(lead, f"rep bigint, mult bigint, v {kind}, y array<double>").withColumn("y0", F.col("y")[0])
    # Ranges of the leading axis; checkpointed, so that a lost task can't move a vector to another block.
    placed = cut(placed.repartitionByRange(blocks, "y0", "rep").withColumn("block", F.spark_partition_id()).drop("y0"))
    bounds = placed.groupBy("block").agg(F.array(*[F.min(F.col("y")[k]) for k in range(box)]).alias("lo"), F.array(*[F.max(F.col("y")[k]) for k in range(box)]).alias("hi"))
    # blocks squared rows at most, by a join on the first block's neighbours; the pair of a block with itself comes once
    pairs = bounds.select("block", F.explode(F.sequence("block", F.lit(blocks - 1))).alias("other"))
    far = bounds.select(F.col("block").alias("f_block"), F.col("lo").alias("f_lo"), F.col("hi").alias("f_hi"))
    near = bounds.select(F.col("block").alias("n_block"), F.col("lo").alias("n_lo"), F.col("hi").alias("n_hi"))
    both = pairs.join(far, F.col("other") == F.col("f_block")).join(near, F.col("block") == F.col("n_block"))
    route = both.select(F.col("block").alias("i"), F.col("other").alias("j"), F.col("block").alias("to"), F.col("f_lo").alias("lo"), F.col("f_hi").alias("hi"))
    route = route.unionByName(both.where("block < other").select(F.col("block").alias("i"), F.col("other").alias("j"), F.col("other").alias("to"), F.col("n_lo").alias("lo"), F.col("n_hi").alias("hi")))
    sent = placed.join(small_enough(route), F.col("block") == F.col("to"))
    gap = F.expr("aggregate(zip_with(y, arrays_zip(lo, hi), (c, b) -> greatest(b.lo - c, c - b.hi, 0d)), 0d, (s, g) -> s + g * g)")
    sent = sent.where((F.col("i") == F.col("j")) | (gap <= 2 - 2 * threshold + EPS)).select("i", "j", "block", "rep", "mult", "v")

    def pair(key, t):
        t = t.combine_chunks()
        i, j = key[0].as_py(), key[1].as_py()
        unit, side = _unit(_list(t["v"])), t["block"].to_numpy()
        a = np.flatnonzero(side == i)
        return _links(t["rep"].to_numpy(), t["mult"].to_numpy(), unit, unit @ axes, a, a if i == j else np.flatnonzero(side == j), threshold)

    return sent.groupBy("i", "j").applyInArrow(pair, FOUND)


def near_duplicate_vectors(vectors: DataFrame, threshold: float = 0.9, block: int | None = None) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding: an array of any numbers).

    Vectors of different lengths link with each other never. Null, empty and zero vectors, vectors that hold null or non-finite components,
    and rows with a null vec_id link with nothing. Repeated rows are vectors of their own.
    Labels and other columns are ignored. block: vectors of a block, at most.
    """
    e = F.col("embedding")
    kind = "float" if vectors.schema["embedding"].dataType.elementType.simpleString() == "float" else "double"
    e = e.cast(f"array<{kind}>")
    base = vectors.select("vec_id", e.alias("v"))
    whole = F.size("v") > 0
    finite = ~F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == math.inf))
    base = base.withColumn("ok", F.coalesce(F.col("vec_id").isNotNull() & whole & finite & F.exists("v", lambda c: c != 0), F.lit(False)))
    # -0 and 0 are equal
    base = base.withColumn("v", F.when(F.col("ok"), F.transform("v", lambda c: c + F.lit(0).cast(kind))))
    rows = base.select("vec_id", "ok", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(7919), "v").alias("h2"), "v")
    classes = cut(rows.where("ok").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("v").alias("v")).withColumn("d", F.size("v")))
    most = lambda d: block or max(1, BLOCK_BYTES // (8 * d))
    # lengths of vectors: no more of them than the longest one has components
    lengths = {r["d"]: r["n"] for r in classes.groupBy("d").agg(F.count(F.lit(1)).alias("n")).collect()}
    many = {d: n for d, n in lengths.items() if n > min(LEAST, most(d))}
    found = classes.where(~F.col("d").isin(list(many))).groupBy("d").applyInArrow(_few(threshold), FOUND)
    for d, n in many.items():
        found = found.unionByName(_many(classes.where(F.col("d") == d), d, n, threshold, most(d)))
    found = cut(found)
    counts = found.groupBy("id").agg(F.sum("n").alias("n"))
    comp = components(found.where("id <> root").select(F.col("id").alias("a"), F.col("root").alias("b")))
    info = classes.select("h1", "h2", "rep", "mult").join(counts, F.col("rep") == counts["id"], "left").drop("id").join(comp, F.col("rep") == comp["id"], "left").drop("id")
    out = rows.where("ok").select("vec_id", "h1", "h2").join(info, ["h1", "h2"])
    component = F.coalesce("component", "rep")
    linked = out.select("vec_id", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).cast("long").alias("n_links"), component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
    return linked.unionByName(rows.where("not ok").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept")))


ORACLE = r"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
u AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS norm FROM v),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.norm * b.norm) >= 0.9),
r AS (SELECT vec_id AS id, vec_id AS seen FROM v UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.seen)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, g.component_id, v.vec_id = g.component_id AS kept
FROM v LEFT JOIN (SELECT a, count(*) AS n FROM l GROUP BY a) n ON n.a = v.vec_id
JOIN (SELECT id, min(seen) AS component_id FROM r GROUP BY id) g ON g.id = v.vec_id
"""
