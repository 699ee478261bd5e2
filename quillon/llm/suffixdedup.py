"""Exact removal of repeated 100-byte strings over a whole corpus, by distributed suffix arrays.

A string of the given length is routed by its content, so that equal strings meet whatever their
documents: the smallest hash of its 32-byte substrings (the leftmost on ties) is its anchor, and a maximal run of
neighbouring strings of one anchor is a block. One pass cuts every text into blocks; each batch of
documents first drops blocks that it holds already, so that a passage of a third of all documents
arrives once a batch, and sends (anchor, hash of block, document, start) as packed arrays by
range of anchors. There, anchors of one block only are unique, and are gone from here on; repeated
equal blocks are removed but for the first; and only where an anchor has several different blocks
do the first copies' bytes have to be looked at.

Those bytes are fetched and, per range of anchors, sorted as suffixes in two stages: only suffixes
smaller than their successors are sorted directly, the others follow by one scan over the buckets
of first bytes. Common prefixes of neighbours follow; where they reach the length, strings are equal, and all but the
first in (doc_id, start) are removed. An anchor of very many different blocks (a short notice in many
texts) would make one large range: its strings are compared one by one by 128-bit hash instead, spread over the cluster.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import bytesops as B
from quillon.llm.common import cut, scratch, stored

LENGTH, GRAM = 100, 32
#: Bytes of text that a range of anchors stands for, about.
RANGE_BYTES = 8 << 20
#: Different blocks of an anchor beyond which its strings are compared one by one.
MANY = 2000
PIECE = 4 << 20
#: Tasks that the ranges are spread over, at most.
TASKS = 1 << 15
#: Texts that drop each other's blocks before anything is sent.
SLICE = 8 << 20
U = np.uint64


def two_stage(t: np.ndarray, depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of bytes t, in order at least up to depth, and the 8-byte words at every position."""
    n = len(t)
    padded = np.concatenate([t, np.zeros(depth + 16, np.uint8)]).astype(np.uint64)
    word = np.zeros(n + depth + 8, np.uint64)
    for k in range(8):
        word |= padded[k : k + len(word)] << U(56 - 8 * k)
    # smaller: suffix i < suffix i + 1; equal first bytes take the type of the successor
    step = np.sign(t[1:].astype(np.int16) - t[:-1].astype(np.int16))
    nxt = np.where(step != 0, np.arange(n - 1), n - 1)
    nxt = np.minimum.accumulate(nxt[::-1])[::-1] if n > 1 else nxt
    smaller = np.append(np.append(step, -1)[nxt] > 0, False)
    b = np.flatnonzero(smaller)
    b = b[np.argsort(word[b], kind="stable")]
    # refine ties eight bytes at a time
    open_ = np.arange(len(b))
    group = np.zeros(len(b), np.int64)
    for s in range(0, depth, 8):
        if s:
            order = np.lexsort((word[b[open_] + s], group))
            b[open_] = b[open_][order]
        w = word[b[open_] + s]
        new = np.ones(len(w), bool)
        new[1:] = (w[1:] != w[:-1]) | (group[1:] != group[:-1])
        group = np.cumsum(new)
        tied = ~(new & np.append(new[1:], True))
        open_, group = open_[tied], group[tied]
        if not len(open_):
            break
    first = np.searchsorted(t[b], np.arange(257))
    lists: list[list[np.ndarray]] = [[] for _ in range(256)]
    if n:
        lists[t[-1]].append(np.array([n - 1]))
    out = []
    for c in range(256):
        part = np.concatenate(lists[c]) if lists[c] else np.zeros(0, np.int64)
        parts = [part]
        while len(part):
            part = part[part > 0] - 1
            part = part[t[part] == c]
            parts.append(part)
        parts.append(b[first[c] : first[c + 1]])
        bucket = np.concatenate(parts)
        if not len(bucket):
            continue
        out.append(bucket)
        prev = bucket[bucket > 0] - 1
        prev = prev[t[prev] > c]
        order = np.argsort(t[prev], kind="stable")
        prev = prev[order]
        head = t[prev]
        cut = np.flatnonzero(np.diff(head)) + 1
        for x in np.split(prev, cut) if len(prev) else []:
            lists[t[x[0]]].append(x)
    return (np.concatenate(out) if out else np.zeros(0, np.int64)), word


def common_prefixes(sa: np.ndarray, word: np.ndarray, depth: int = LENGTH) -> np.ndarray:
    """For each place but the first: how many bytes it and the one before share, up to depth."""
    p, q = sa[:-1], sa[1:]
    out = np.zeros(len(p), np.int64)
    on = np.arange(len(p))
    for s in range(0, depth, 8):
        x = word[p + s] ^ word[q + s]
        same = x == 0
        # equal bytes before the first one that differs
        y = x[~same]
        n = np.zeros(len(y), np.int64)
        for k in (32, 16, 8):
            small = y < U(1 << (64 - k))
            n[small] += k // 8
            y[small] <<= U(k)
        out[on[~same]] = s + n
        on, p, q = on[same], p[same], q[same]
    out[on] = depth
    return np.minimum(out, depth)


def equal_neighbours(sa: np.ndarray, word: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each place but the first: do it and the one before share their first length bytes?"""
    return common_prefixes(sa, word, length) >= length


def _prefix(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, q = B._power(len(buf) + 1)
    h = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(B._BYTE[buf] * p[: len(buf)], out=h[1:])
    return h, q


def blocks(buf: np.ndarray, offs: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """Anchor, hash, text, start and number of strings of every block of the texts (at most 2^24 bytes in all)."""
    n = len(buf)
    none = (np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    if n < length:
        return none
    h, q = _prefix(buf)
    g = B.mix((h[GRAM:] - h[:-GRAM]) * q[: n - GRAM + 1])
    m = (g & ~U(0xFFFFFF)) | np.arange(len(g), dtype=np.uint64)
    w, have = length - GRAM + 1, 1
    while have * 2 <= w:
        m = np.minimum(m[:-have], m[have:])
        have *= 2
    if have < w:
        m = np.minimum(m[: len(m) - (w - have)], m[w - have :])
    sizes = np.diff(offs)
    doc = np.repeat(np.arange(len(sizes)), sizes)[: len(m)]
    inside = np.arange(len(m)) + length <= offs[1:][doc]
    at = (m & U(0xFFFFFF)).astype(np.int64)
    j = np.flatnonzero(inside)
    if not len(j):
        return none
    new = np.ones(len(j), bool)
    new[1:] = (at[j][1:] != at[j][:-1]) | (j[1:] != j[:-1] + 1)
    s = np.flatnonzero(new)
    start = j[s]
    count = np.diff(np.append(s, len(j)))
    end = start + count + length - 1
    body = B.mix((h[end] - h[start]) * q[start] + (end - start).astype(np.uint64) * U(0x9E3779B97F4A7C15))
    d = doc[start]
    # a smallest hash is a small one: mixed again, it falls on all ranges alike
    return B.mix(g[at[start]] ^ U(0xA0761D6478BD642F)), body, d, start - offs[d], count


def _pieces(buf: np.ndarray, offs: np.ndarray, length: int) -> Iterator[tuple[np.ndarray, ...]]:
    for i, j in B.groups(offs, PIECE // 8):
        if offs[j] - offs[i] <= PIECE:
            a, b, d, s, c = blocks(buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i], length)
            yield a, b, d + i, s, c
        else:
            for at in range(0, int(offs[j] - offs[i]), PIECE):
                x = buf[offs[i] + at : min(offs[i] + at + PIECE + length - 1, offs[j])]
                a, b, d, s, c = blocks(x, np.array([0, len(x)]), length)
                yield a, b, d + i, s + at, c


def _first(cols: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Order by (anchor, hash, document, start), and where in it a new (anchor, hash) begins."""
    a, b, d, s = cols[:4]
    order = np.lexsort((s, d, b, a))
    new = np.ones(len(order), bool)
    new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
    return order, new


def _pack(cols: list[np.ndarray]) -> bytes:
    a, b, d, s, c = cols
    return b"".join([a.tobytes(), b.tobytes(), np.diff(d, prepend=0).tobytes(), s.tobytes(), c.astype(np.int16).tobytes()])


def _unpack(blob: bytes, n: int) -> list[np.ndarray]:
    x = np.frombuffer(blob, np.uint8)
    cut = np.cumsum([0, 8 * n, 8 * n, 8 * n, 8 * n, 2 * n])
    a, b, d, s, c = (x[cut[k] : cut[k + 1]] for k in range(5))
    return [a.view(U), b.view(U), np.cumsum(d.view(np.int64)), s.view(np.int64), c.view(np.int16).astype(np.int64)]


def removed_windows(docs: DataFrame, folder: str, length: int = LENGTH, many: int = MANY) -> DataFrame:
    """doc_id, start, n: runs of strings of that length (by first byte of the first) that start earlier elsewhere, too. folder: where tables that this depends on may lie."""
    texts = docs.select("doc_id", "text").where("doc_id is not null and octet_length(text) >= " + str(length))
    total = texts.agg(F.sum(F.octet_length("text").cast("long")).alias("n")).first()["n"] or 0
    bits = max(4, math.ceil(math.log2(total / RANGE_BYTES + 1)))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            buf, offs = B.raw(batch.column(1))
            for i, j in B.groups(offs, SLICE):
                yield sliced(ids[i:j], buf, offs[i : j + 1])

    def sliced(ids: np.ndarray, buf: np.ndarray, offs: np.ndarray) -> pa.RecordBatch:
        a, b, d, s, c = (np.concatenate(x) for x in zip(*_pieces(buf, offs, length), strict=True))
        d = ids[d]
        order, new = _first((a, b, d, s))
        bucket = (a >> U(64 - bits)).astype(np.int64)
        # what is removed here meets nothing any more: it passes through a range of its own, wherever that is
        aside = -1 - int(B.mix(ids[:1].astype(np.uint64))[0] >> U(40)) if len(ids) else -1
        out: dict[str, list] = {"bucket": [], "n": [], "own": [], "blob": []}
        for own, rows in ((False, order[new]), (True, order[~new])):
            # by document, for small differences
            for k, x in _by(np.full(len(rows), aside) if own else bucket[rows], rows):
                x = x[np.lexsort((s[x], d[x]))]
                zero = np.zeros(len(x), U)
                out["bucket"].append(k)
                out["n"].append(len(x))
                out["own"].append(own)
                out["blob"].append(_pack([zero if own else a[x], zero if own else b[x], d[x], s[x], c[x]]))
        return pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int64()), pa.array(out["n"], pa.int64()), pa.array(out["own"], pa.bool_()), pa.array(out["blob"], pa.binary())], names=["bucket", "n", "own", "blob"])

    sent = texts.mapInArrow(split, "bucket bigint, n bigint, own boolean, blob binary")
    # a range a task, as far as that goes, rather than what hashes of the ranges bring together
    tasks = min(1 << bits, TASKS)
    together = lambda df: df.repartitionById(tasks, F.pmod("bucket", F.lit(tasks)).cast("int")).sortWithinPartitions("bucket")
    meet = together(sent)

    def settle(parts: list[tuple[int, bool, bytes]]) -> Iterator[pa.RecordBatch]:
        own = [_unpack(b, n) for n, o, b in parts if o]
        rest = [_unpack(b, n) for n, o, b in parts if not o]
        for x in own:
            yield _runs(x[2], x[3], x[4])
        if not rest:
            return
        a, b, d, s, c = (np.concatenate(x) for x in zip(*rest, strict=True))
        order, new = _first((a, b, d, s))
        again = order[~new]
        yield _runs(d[again], s[again], c[again])
        reps = order[new]
        key = a[reps]
        edge = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        size = np.diff(np.append(edge, len(key)))
        size = np.repeat(size, size)
        x, size = reps[size > 1], size[size > 1]
        yield _runs(d[x], s[x], c[x], a[x].view(np.int64), size > many)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        for batch in batches:
            for k, n, o, b in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if k != now and parts:
                    yield from settle(parts)
                    parts = []
                now = k
                parts.append((n, o, b))
        if parts:
            yield from settle(parts)

    settled = stored(meet.mapInArrow(merge, "doc_id bigint, start bigint, n bigint, anchor bigint, hot boolean"), folder)
    wanted = settled.where("anchor is not null").groupBy("doc_id").agg(F.collect_list(F.struct("start", "n", "anchor", "hot")).alias("want"))
    fetched = texts.join(wanted.hint("shuffle_hash"), "doc_id")

    def bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Bytes of blocks, by range of anchors; of hot anchors, the hash of each string by itself."""
        for batch in batches:
            buf, offs = B.raw(batch.column(1))
            want = batch.column(2)
            w = want.flatten()
            doc = np.repeat(np.arange(len(batch)), np.diff(want.offsets.to_numpy()))
            start, n, anchor, hot = (w.field(k).to_numpy(zero_copy_only=False) for k in range(4))
            ids = batch.column(0).to_numpy()[doc]
            frm, to = offs[doc] + start, offs[doc] + start + n + length - 1
            bucket = (anchor.view(U) >> U(64 - bits)).astype(np.int64)
            cold = np.flatnonzero(~hot)
            for z in range(0, len(cold), 20_000):
                y = cold[z : z + 20_000]
                yield pa.RecordBatch.from_arrays([pa.array(bucket[y]), pa.array(ids[y]), pa.array(start[y]), pa.array([buf[frm[k] : to[k]].tobytes() for k in y], pa.binary()), pa.nulls(len(y), pa.int64()), pa.nulls(len(y), pa.int64())], names=["bucket", "doc_id", "start", "body", "h1", "h2"])
            for k in np.flatnonzero(hot):
                x = buf[frm[k] : to[k]].tobytes()
                h = np.frombuffer(b"".join(hashlib.blake2b(x[o : o + length], digest_size=16).digest() for o in range(int(n[k]))), np.int64).reshape(-1, 2)
                m = len(h)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(m, -1)), pa.array(np.full(m, ids[k])), pa.array(start[k] + np.arange(m)), pa.nulls(m, pa.binary()), pa.array(h[:, 0]), pa.array(h[:, 1])], names=["bucket", "doc_id", "start", "body", "h1", "h2"])

    schema = "bucket bigint, doc_id bigint, start bigint, body binary, h1 bigint, h2 bigint"
    seen = stored(fetched.select("doc_id", "text", "want").mapInArrow(bodies, schema), folder)
    cold = seen.where("bucket >= 0").select("bucket", "doc_id", "start", "body")

    def sort(ids: list[int], starts: list[int], bodies_: list[bytes]) -> pa.RecordBatch:
        t = np.frombuffer(b"\0".join(bodies_) + b"\0", np.uint8)
        sizes = np.array([len(x) for x in bodies_])
        base = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
        sa, word = two_stage(t, length)
        row = np.repeat(np.arange(len(sizes)), sizes + 1)
        off = np.arange(len(t)) - base[row]
        whole = off + length <= sizes[row]
        same = np.append(False, equal_neighbours(sa, word, length))
        group = np.cumsum(~same)
        ok = whole[sa]
        sa, group = sa[ok], group[ok]
        d, s = np.array(ids, np.int64)[row[sa]], np.array(starts, np.int64)[row[sa]] + off[sa]
        order = np.lexsort((s, d, group))
        g, d, s = group[order], d[order], s[order]
        again = np.append(False, g[1:] == g[:-1]) if len(g) else np.zeros(0, bool)
        d, s = d[again], s[again]
        order = np.lexsort((s, d))
        d, s = d[order], s[order]
        new = np.ones(len(d), bool)
        new[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1] + 1)
        at = np.flatnonzero(new)
        return _runs(d[at], s[at], np.diff(np.append(at, len(d))))

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            for r in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if r[0] != now and rows:
                    yield sort(*map(list, zip(*rows, strict=True)))
                    rows = []
                now = r[0]
                rows.append(r[1:])
        if rows:
            yield sort(*map(list, zip(*rows, strict=True)))

    runs = "doc_id bigint, start bigint, n bigint, anchor bigint, hot boolean"
    by_array = together(cold).mapInArrow(arrays, runs).select("doc_id", "start", "n")
    strings = seen.where("bucket < 0").select("h1", "h2", "doc_id", "start")
    earliest = strings.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "start")).alias("e"), F.count(F.lit(1)).alias("k")).where("k > 1").select("h1", "h2", "e")
    by_hash = strings.join(earliest, ["h1", "h2"]).where(F.struct("doc_id", "start") > F.col("e")).select("doc_id", "start", F.lit(1).cast("long").alias("n"))
    return settled.where("anchor is null").select("doc_id", "start", "n").unionByName(by_array).unionByName(by_hash)


def _by(key: np.ndarray, rows: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    if not len(key):
        return
    order = np.argsort(key, kind="stable")
    k = key[order]
    at = np.flatnonzero(np.append(True, k[1:] != k[:-1]))
    for s, e in zip(at, np.append(at[1:], len(k)), strict=True):
        yield int(k[s]), rows[order[s:e]]


def _runs(d, s, n, anchor=None, hot=None) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(d, pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.nulls(len(d), pa.int64()) if anchor is None else pa.array(anchor), pa.nulls(len(d), pa.bool_()) if hot is None else pa.array(hot)],
        names=["doc_id", "start", "n", "anchor", "hot"],
    )


def _cover(docs: DataFrame, folder: str, length: int, many: int) -> DataFrame:
    """doc_id, text, gone: the removed strings of each document (null: none)."""
    gone = removed_windows(docs, folder, length, many).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("gone"))
    return docs.select("doc_id", "text").join(gone.hint("shuffle_hash"), "doc_id", "left")


def _covered(size: int, starts: np.ndarray, counts: np.ndarray, length: int) -> np.ndarray:
    mark = np.zeros(size + 1, np.int32)
    np.add.at(mark, starts, 1)
    np.add.at(mark, np.minimum(starts + counts + length - 1, size), -1)
    return np.cumsum(mark[:-1]) > 0


def digest(docs: DataFrame, length: int = LENGTH, many: int = MANY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 for every row of docs.

    A byte goes if a string of length bytes that covers it starts earlier, too: in a smaller doc_id, or before in the
    document. Null text is empty. Rows with a null doc_id are neither searched nor found. Rows that share a doc_id
    are read as one document: what is removed at an offset of one is removed at that offset of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, offs = B.raw(batch.column(1))
            gone = batch.column(2)
            flat, at = gone.flatten(), np.concatenate([[0], np.cumsum(np.nan_to_num(gone.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64))])
            starts, counts = flat.field(0).to_numpy(), flat.field(1).to_numpy()
            rows: list[list] = [[], [], [], []]
            for i in range(len(batch)):
                x = buf[offs[i] : offs[i + 1]]
                if at[i] == at[i + 1]:
                    removed, n_spans, kept = 0, 0, x
                else:
                    s = starts[at[i] : at[i + 1]]
                    fits = s < len(x)
                    c = _covered(len(x), s[fits], counts[at[i] : at[i + 1]][fits], length)
                    removed, kept = int(c.sum()), x[~c]
                    n_spans = int(c[0]) + int((c[1:] & ~c[:-1]).sum())
                for r, v in zip(rows, (len(x), removed, n_spans, hashlib.sha256(kept.tobytes()).hexdigest()), strict=True):
                    r.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(r, pa.int64()) for r in rows[:3]), pa.array(rows[3], pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    with scratch(docs.sparkSession) as folder:
        return cut(_cover(docs, folder, length, many).mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string"))


ORACLE = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i - 1, 200) AS s FROM (SELECT doc_id, h, unnest(range(1, greatest(len(h) // 2 - 98, 1))) AS i FROM d)),
f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM w),
g AS (SELECT doc_id, i, i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS gap FROM f WHERE r > 1),
n AS (SELECT doc_id, i, sum(CASE WHEN gap <= 100 THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM g),
x AS (SELECT doc_id, k, min(i) AS a, max(i) + 99 AS b FROM n GROUP BY doc_id, k),
p AS (SELECT x.doc_id, x.k, x.a, x.b, substr(h, 2 * coalesce(lag(x.b) OVER (PARTITION BY x.doc_id ORDER BY x.k), 0) + 1,
    2 * (x.a - 1 - coalesce(lag(x.b) OVER (PARTITION BY x.doc_id ORDER BY x.k), 0))) AS piece FROM x JOIN d ON d.doc_id = x.doc_id),
r AS (SELECT doc_id, sum(b - a + 1) AS n_removed, count(*) AS n_spans, string_agg(piece, '' ORDER BY k) AS head, max(b) AS last FROM p GROUP BY doc_id)
SELECT d.doc_id, len(h) // 2 AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0) AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN r ON r.doc_id = d.doc_id
"""
