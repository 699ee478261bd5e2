"""Near-duplicate documents by SuperMinHash.

One pass over the texts gives each document its number of distinct two-word shingles, a
128-bit hash of the whole set and a SuperMinHash signature, in which every element draws
correlated ranks (the j-th draw of an element lies in [j, j + 1) and the slots of its draws
are a permutation), so that the variance is lower than with independent hashes and
drawing stops as soon as every slot is taken. Equal sets collapse to one representative by
an aggregate. Signatures of representatives are banded; the documents of a bucket are
compared with its centres only, in rounds: first one centre, then ever more, and only
where a bucket still spans several components, until every pair that shares a bucket is
either compared on its full sets or joined already. No pair is compared twice, and none whose sizes alone
rule a link out. New links join components of the round before, so the graph shrinks as it goes.

32 bands of 6 rows miss a pair of similarity 0.8 with a chance of 6 in 100,000, and of
0.9 with 1 in 10^10.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import bytesops as B
from quillon.llm.common import cut, small_enough, without
from quillon.llm.components import components

ROWS, BANDS = 6, 32
_FREE = np.uint64(0xFFFFFFFFFFFFFFFF)


def superminhash(sets: list[np.ndarray], m: int = ROWS * BANDS) -> np.ndarray:
    """Signatures (len(sets) x m) of sets of 64-bit hashes, all sets in step, round by round; an empty set stays free."""
    sizes = np.array([len(s) for s in sets])
    sig = np.full(len(sets) * m, _FREE, np.uint64)
    e = np.concatenate(sets) if len(sets) else np.zeros(0, np.uint64)
    doc = np.repeat(np.arange(len(sets)), sizes)
    perm = None
    for j in range(m):
        if not len(e):
            break
        r = B.mix(e + np.uint64((j + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF))
        k = j + ((r >> np.uint64(32)) * np.uint64(m - j) >> np.uint64(32)).astype(np.int64)
        if perm is None:
            slot = k
        else:
            row = np.arange(len(e))
            slot = perm[row, k].astype(np.int64)
            perm[row, k] = perm[row, j]
        np.minimum.at(sig, doc * m + slot, np.uint64(j << 32) | (r & np.uint64(0xFFFFFFFF)))
        going = (sig.reshape(-1, m) == _FREE).any(axis=1)[doc]
        if perm is None or going.sum() < 0.7 * len(e):
            if perm is None:
                perm = np.tile(np.arange(m, dtype=np.uint8 if m <= 256 else np.uint16), (int(going.sum()), 1))
                kk = k[going]
                perm[np.arange(len(kk)), kk] = 0
            else:
                perm = perm[going]
            e, doc = e[going], doc[going]
    return sig.reshape(-1, m)


def band_keys(sig: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = sig.shape[1] // rows
    x = sig.reshape(len(sig), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), (len(sig), bands)).copy()
    for i in range(rows):
        key = B.mix(key * np.uint64(0x9FB21C651E98DF25) + x[:, :, i])
    return key.view(np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = B.raw(batch.column(1))
        for i, j in B.groups(offs):
            sets = B.shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            full = np.array([len(s) > 0 for s in sets])
            keys = band_keys(superminhash(sets))
            digest = np.frombuffer(b"".join(hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets), np.int64).reshape(-1, 2)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(sets) + 1, dtype=np.int32) * BANDS), pa.array(keys.reshape(-1)))
            lists = pa.compute.if_else(pa.array(full), lists, pa.scalar(None, lists.type))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array([len(s) for s in sets], pa.int64()), pa.array(digest[:, 0]), pa.array(digest[:, 1]), lists],
                names=["doc_id", "th", "n", "h1", "h2", "bands"],
            )


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = B.raw(batch.column(1))
        for i, j in B.groups(offs):
            sets = B.shingle_sets(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i])
            ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(sets).view(np.int64)))], names=["id", "s"])


def _verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (a, b) those whose full sets are similar enough. Links only travel as ids afterwards."""
    x = pairs.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    y = x.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    common = F.size(F.array_intersect("sa", "sb"))
    return y.where(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct()


def _joined(comp: DataFrame, links: DataFrame) -> DataFrame:
    """comp (id, component) after links (a, b) of ids; only components that are linked anew are gone through."""
    name = lambda c: comp.select(F.col("id").alias(f"{c}_id"), F.col("component").alias(f"{c}_component"))
    between = links.join(name("a"), F.col("a") == F.col("a_id")).join(name("b"), F.col("b") == F.col("b_id")).where("a_component <> b_component")
    found = components(between.select(F.col("a_component").alias("a"), F.col("b_component").alias("b")))
    moved = found.select(F.col("id").alias("m_id"), F.col("component").alias("m_component"))
    return cut(comp.join(moved, F.col("component") == F.col("m_id"), "left").select("id", F.coalesce("m_component", "component").alias("component")))


def near_duplicates(docs: DataFrame, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs; see _grouped."""
    return _grouped(docs, percent).drop("th")


def _grouped(docs: DataFrame, percent: int) -> DataFrame:
    """doc_id, th (hash of the text), n_shingles, component_id, kept for every row of docs.

    Null and empty texts, and texts of blanks, have no shingles and are linked with nothing. Rows with a null doc_id
    have no component and are kept. Rows that share a doc_id are one node for links, and each gets the
    component of its own text. Other columns are ignored.
    """
    base = docs.select("doc_id", "text")
    signed = cut(base.select("doc_id", "text", F.xxhash64("text").alias("th")).mapInArrow(_sign, "doc_id bigint, th bigint, n bigint, h1 bigint, h2 bigint, bands array<bigint>"))
    # one representative of each set; equal sets are the same bands, so any() of them will do
    reps = signed.where("n > 0 and doc_id is not null").groupBy("h1", "h2").agg(F.min("doc_id").alias("rep"), F.first("n").alias("size"), F.first("bands").alias("bands"))
    rows = reps.select("rep", "size", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("rep").alias("low"), F.max("rep").alias("high")).where("low < high").select("key")
    members = cut(rows.join(shared, "key"))
    ids = cut(members.select(F.col("rep").alias("doc_id")).distinct())
    sets = cut(base.join(small_enough(ids), "doc_id").mapInArrow(_sets, "id bigint, s array<bigint>"))
    comp, done, turn = ids.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("component")), None, 0
    while True:
        placed = members.join(comp, members["rep"] == comp["id"]).select("key", "rep", "size", "component")
        span = placed.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("key")
        left = cut(placed.join(span, "key"))
        if left.isEmpty():
            break
        # Centres: the smallest member of each of 1, 4, 16 ... parts of a bucket.
        parts = 4 ** max(0, turn - 1)
        part = F.pmod(F.xxhash64("rep"), F.lit(parts))
        centres = left.groupBy("key", part.alias("part")).agg(F.min(F.struct("rep", "component", "size")).alias("c"))
        centres = centres.select("key", F.col("c.rep").alias("a"), F.col("c.component").alias("ca"), F.col("c.size").alias("sa"))
        pairs = left.join(centres, "key").where("a <> rep and ca <> component").where(100 * F.least("sa", "size") >= percent * F.greatest("sa", "size"))
        pairs = pairs.select(F.least("a", "rep").alias("a"), F.greatest("a", "rep").alias("b"))
        if turn == 0:
            # one centre for each member joins most of them; the pairs left out are looked at again
            pairs = pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")
        else:
            pairs = pairs.distinct()
            members = cut(left.select("key", "rep", "size").join(centres.select("key", F.col("a").alias("rep")), ["key", "rep"], "left_anti"))
        pairs = cut(pairs if done is None else pairs.join(done, ["a", "b"], "left_anti"))
        done = pairs if done is None else done.unionByName(pairs)
        comp = _joined(comp, _verify(pairs, sets, percent))
        turn += 1
    whole = reps.select("h1", "h2", "rep").join(comp.select(F.col("id").alias("rep"), "component"), "rep", "left")
    # the component's name must be its smallest doc_id, and a representative is the smallest of its set
    whole = whole.select("h1", "h2", F.coalesce("component", "rep").alias("component"))
    out = signed.select("doc_id", "th", "n", "h1", "h2").join(whole, ["h1", "h2"], "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    component = F.when(F.col("doc_id").isNotNull(), component)
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def near_dedup(docs: DataFrame, percent: int = 80) -> DataFrame:
    """docs with one document of each group of near duplicates, that of smallest doc_id; columns as in docs. Rows with a null doc_id stay."""
    return without(docs, _grouped(docs, percent).where("not kept").select("doc_id", "th"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, ws[i] || ' ' || coalesce(ws[i + 1], '') AS sh
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws), 2))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS i FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id <> y.doc_id GROUP BY x.doc_id, y.doc_id),
l AS (SELECT a, b FROM c JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * i >= 80 * (na.n + nb.n - i)),
r AS (SELECT doc_id AS id, doc_id AS seen FROM w UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.seen)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, g.component_id, w.doc_id = g.component_id AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT id, min(seen) AS component_id FROM r GROUP BY id) g ON g.id = w.doc_id
"""
