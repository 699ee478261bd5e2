"""Quality by perplexity under an interpolated modified Kneser-Ney model of trusted text.

Text is read as words and runs of marks. The WORDS most frequent of them in the trusted text are known one by one, all
others by their kind and length; a word that repeats the one before it is read as the number of times it has done so,
since running repetition is what distinguishes filler. The model is of order 3. Its counts grow with the
text and never meet in one place: every task sums its own trigrams and sends them, packed, to the shard of their middle word; if that is one of
the HOT most frequent words, of their first two; and if both of these are, of all three. A shard thus has all that a trigram's probability asks for:
the counts of the trigram and of its context, and the numbers of contexts that its last two words
follow. Of hot words these are summed apart, for all shards: HOT x WORDS numbers at most, and a few for each of HOT x HOT contexts. Beside them, the driver
gets counts of counts, and one number a known word.

Documents are scored by a join of the same shards: every task sends the distinct trigrams of its documents to the
shards, which return sums by document. The documents' perplexities are held against quantiles over held-out trusted
documents of their language and length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm import bytesops as B
from quillon.llm.common import cut, scratch, small_enough, stored, without

#: Words known one by one, and those of them whose trigrams are spread by the first word, too.
WORDS, HOT = 8192, 256
#: Numbers of words that aren't known: by kind and length; of the times that a word is repeated; of the start of a text.
KINDS, RUNS, START = WORDS, WORDS + 32, WORDS + 63
ALL, BITS = WORDS + 64, 14
LOW, PAIR = (1 << BITS) - 1, (1 << 2 * BITS) - 1
#: Trusted text that a shard stands for, and the tokens of the documents that a task sends at once, about.
SHARD_BYTES, TOKENS = 16 << 20, 1 << 20
HELD_OUT = 5

_MARK = ~B.ALNUM
_MARK[[32, 9, 10, 11, 12, 13]] = False


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of each token of the texts, its number if it isn't a known word (for repetitions, always), negative for the latter, and tokens by text."""
    s1, e1, n1 = B.spans(buf, offs, B.ALNUM)
    s2, e2, n2 = B.spans(buf, offs, _MARK)
    start, end = np.concatenate([s1, s2]), np.concatenate([e1, e2])
    order = np.argsort(start, kind="stable")
    start, end = start[order], end[order]
    h = B.hashes(buf, start, end)
    first = buf[start]
    kind = np.where(order >= len(s1), 3, np.where((first >= 48) & (first < 58), 2, 0))
    upper = lambda c: (c >= 65) & (c < 91)
    kind[(kind == 0) & (end - start > 1) & upper(first) & upper(buf[np.minimum(start + 1, len(buf) - 1)])] = 1
    number = KINDS + kind * 8 + np.minimum(7, 2 * np.log2(end - start)).astype(np.int64)
    n = n1 + n2
    same = np.zeros(len(h), bool)
    same[1:] = h[1:] == h[:-1]
    at = np.cumsum(n)[:-1]
    same[at[at < len(h)]] = False
    run = np.arange(len(h)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(h)))) if len(h) else np.zeros(0, np.int64)
    times = np.where(run < 4, run, 2 + np.log2(np.maximum(run, 1)).astype(np.int64))
    return h, np.where(same, -(RUNS + np.minimum(times, 30)), number), n


class Vocabulary:
    def __init__(self, hashes: np.ndarray):
        """hashes: of the known words, most frequent first."""
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def numbers(self, h: np.ndarray, other: np.ndarray) -> np.ndarray:
        if not len(self.hashes):
            return np.abs(other)
        at = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        return np.where((other >= 0) & (self.hashes[at] == h), self.order[at], np.abs(other))

    def trigrams(self, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code of the trigram that ends at each token, and the number of tokens of each text."""
        h, other, n = tokens(buf, offs)
        w = self.numbers(h, other)
        at = np.cumsum(n) - n
        at = at[n > 0]
        code = w.copy()
        back = w
        for k in (1, 2):
            back = np.concatenate([[START], back[:-1]]) if len(w) else back
            back[at] = START
            code |= back << k * BITS
        return code, n


def _hot_row(word: np.ndarray) -> np.ndarray:
    """Row of a hot word, or of a number that is no word's, in the tables of hot words; -1 for others."""
    return np.where(word < HOT, word, np.where(word >= WORDS, word - WORDS + HOT, -1))


def shard_of(code: np.ndarray, shards: int) -> np.ndarray:
    middle = (code >> BITS) & LOW
    hot, both = _hot_row(middle) >= 0, _hot_contexts(code) >= 0
    key = np.where(both, code, np.where(hot, (code >> BITS) + (1 << 3 * BITS), middle + (1 << 4 * BITS)))
    return (B.mix(key.astype(np.uint64)) % np.uint64(shards)).astype(np.int64)


def _hot_contexts(code: np.ndarray) -> np.ndarray:
    """Number of a context of two hot words; -1 for others."""
    u, v = _hot_row(code >> 2 * BITS), _hot_row((code >> BITS) & LOW)
    return np.where((u >= 0) & (v >= 0), u * (HOT + 64) + v, -1)


def pack(*columns: np.ndarray) -> bytes:
    """Columns of whole numbers as bytes: the first is sorted and becomes differences; like bytes of all numbers stand together."""
    out = [np.array([len(columns)] + [len(c) for c in columns], np.int64).tobytes()]
    for k, c in enumerate(columns):
        c = np.diff(c, prepend=0) if k == 0 else c
        kind = np.uint16 if k and len(c) and c.max() < 1 << 16 else np.uint64
        out.append(bytes([kind().itemsize]))
        out.append(c.astype(kind).view(np.uint8).reshape(len(c), kind().itemsize).T.tobytes())
    raw = b"".join(out)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(blob: bytes) -> list[np.ndarray]:
    raw = pa.decompress(blob[8:], int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True)
    k = int.from_bytes(raw[:8], "little")
    sizes = np.frombuffer(raw, np.int64, k, 8)
    at, out = 8 * (k + 1), []
    for i, n in enumerate(sizes):
        width = raw[at]
        c = np.frombuffer(raw, np.uint8, n * width, at + 1).reshape(width, n).T.copy().view(f"<u{width}").reshape(-1).astype(np.int64)
        out.append(np.cumsum(c) if i == 0 else c)
        at += 1 + n * width
    return out


def _grouped(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes in order, and the sums of their n."""
    order = np.argsort(code, kind="stable")
    code, n = code[order], n[order]
    new = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    return code[new], np.add.reduceat(n, new) if len(new) else n


def _by(key: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each key and the places that hold it, in order."""
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.diff(key[order])) + 1
    for part in np.split(order, cuts) if len(order) else []:
        yield int(key[part[0]]), part


def _parts(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    buf, offs = B.raw(texts)
    for i, j in B.groups(offs):
        yield i, j, buf[offs[i] : offs[j]], offs[i : j + 1] - offs[i]


# Rows on their way: to (a shard or a number), kind, key, n, blob.
ROW = "to bigint, kind int, key bigint, n bigint, blob binary"
TRIGRAMS, NUMBERS, ASKED, DOCUMENTS, SUMS = range(5)
#: Rows of the table of numbers that are summed for the driver: of the hot words' pairs, by last word; of the other pairs, by last word;
#: how many counts of 1 to 4 there are in orders 2 and 3; and of each context of two hot words, the total of its counts and how many are 1, 2 and more.
#: It travels in parts of so many rows.
OTHERS, COUNTS, CONTEXTS, PART = HOT + 64, HOT + 65, HOT + 66, 20
HEIGHT = CONTEXTS + -(-4 * (HOT + 64) ** 2 // ALL)


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["to", "kind", "key", "n", "blob"])


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Runs of rows of one `to`; each must be read to its end."""
    rows = (r for b in batches for r in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True))
    return ((k, g) for k, g in groupby(rows, key=lambda r: r[0]))


def _together(df: DataFrame, shards: int = 0) -> DataFrame:
    """Rows of one `to` side by side; of shards, each in a task of its own."""
    return (df.repartitionById(shards, F.col("to").cast("int")) if shards else df.repartition(F.col("to"))).sortWithinPartitions("to", "kind")


def discounts(n: list[float]) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and more, after Chen and Goodman, from the numbers of counts 1 to 4; where these are missing, their usual stand-ins."""
    if not n[0] or not n[1]:
        return np.array([0, 0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    d = [k + 1 - (k + 2) * y * n[k + 1] / n[k] if n[k] else 0.0 for k in range(3)]
    return np.array([0.0] + [min(max(x, 0.05), k + 0.95) for k, x in enumerate(d)])


def _context(key: np.ndarray, c: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of sorted contexts and the counts within them: the distinct contexts, where each count's is, their totals, and the share left to the lower order."""
    new = np.append(True, key[1:] != key[:-1])
    where = np.cumsum(new) - 1
    total = np.bincount(where, weights=c)
    return key[new], where, total, np.bincount(where, weights=d[np.minimum(c, 3)]) / total


def _look(keys: np.ndarray, values: np.ndarray, q: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(q), default)
    at = np.minimum(np.searchsorted(keys, q), len(keys) - 1)
    return np.where(keys[at] == q, values[at], default)


class Model:
    """What every shard needs beside its own trigrams: discounts, the lowest order, and the second for hot words."""

    def __init__(self, two: list[float], three: list[float], last: np.ndarray, hot: np.ndarray, contexts: np.ndarray):
        """two, three: how many counts of 1 to 4 there are in these orders; last: by word, how many words it follows; hot: by hot word and word, how many words
        stand before both; contexts: by context of hot words, the total of its counts, and how many are 1, 2 and more."""
        self.d2, self.d3 = discounts(two), discounts(three)
        d1 = discounts([float((last == k).sum()) for k in (1, 2, 3, 4)])
        off = d1[np.minimum(last, 3)]
        total = max(float(last.sum()), 1.0)
        self.p1 = (last - off) / total + (off.sum() / total if last.any() else 1.0) / ALL
        self.hot = hot.astype(np.int32)
        sums = hot.sum(axis=1)
        self.hot_total = np.maximum(sums, 1).astype(float)
        self.hot_left = np.where(sums > 0, self.d2[np.minimum(hot, 3)].sum(axis=1) / self.hot_total, 1.0)
        self.both_total = np.maximum(contexts[:, 0], 1).astype(float)
        self.both_left = np.where(contexts[:, 0] > 0, contexts[:, 1:] @ self.d3[1:] / self.both_total, 1.0)


class Shard:
    """Costs, -ln P(last | first two), of the trigrams of one shard."""

    def __init__(self, model: Model, code: np.ndarray, count: np.ndarray):
        self.m, self.code, self.count = model, code, count
        z = np.zeros(0)
        self.context = self.total = self.left = self.pair = self.pair_p = self.word = self.word_left = z
        if len(code):
            alone = _hot_contexts(code) < 0
            if alone.any():
                self.context, _, self.total, self.left = _context(code[alone] >> BITS, count[alone], model.d3)
            pair, before = _grouped(code & PAIR, np.ones(len(code), np.int64))
            own = _hot_row(pair >> BITS) < 0
            pair, before = pair[own], before[own]
            if len(pair):
                self.word, where, total, self.word_left = _context(pair >> BITS, before, model.d2)
                self.pair, self.pair_p = pair, (before - model.d2[np.minimum(before, 3)]) / total[where]

    def cost(self, code: np.ndarray) -> np.ndarray:
        m, middle, last = self.m, (code >> BITS) & LOW, code & LOW
        p2 = _look(self.pair, self.pair_p, code & PAIR, 0.0) + _look(self.word, self.word_left, middle, 1.0) * m.p1[last]
        row = _hot_row(middle)
        h = np.flatnonzero(row >= 0)
        c, r = m.hot[row[h], last[h]], row[h]
        p2[h] = (c - m.d2[np.minimum(c, 3)]) / m.hot_total[r] + m.hot_left[r] * m.p1[last[h]]
        c = _look(self.code, self.count, code, 0).astype(np.int64)
        total, left = _look(self.context, self.total, code >> BITS, 1.0), _look(self.context, self.left, code >> BITS, 1.0)
        both = _hot_contexts(code)
        h = np.flatnonzero(both >= 0)
        total[h], left[h] = m.both_total[both[h]], m.both_left[both[h]]
        return -np.log((c - m.d3[np.minimum(c, 3)]) / total + left * p2)


def _known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words of the task's texts and how often they occur."""

    def out(hs: list, ns: list) -> pa.RecordBatch:
        h, n = _grouped(np.concatenate(hs), np.concatenate(ns))
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["word", "n"])

    hs, ns, size = [], [], 0
    for batch in batches:
        for _, _, buf, offs in _parts(batch.column(0)):
            h, other, _ = tokens(buf, offs)
            h, n = np.unique(h[other >= 0], return_counts=True)
            hs.append(h)
            ns.append(n)
            size += len(h)
            if size > TOKENS:
                yield out(hs, ns)
                hs, ns, size = [], [], 0
    if hs:
        yield out(hs, ns)


def vocabulary(text: DataFrame) -> Vocabulary:
    """The most frequent words that text (text) holds twice at least."""
    words = text.mapInArrow(_known, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where("n > 1")
    # at most WORDS rows
    top = words.orderBy(F.desc("n"), "word").limit(WORDS).toPandas()
    return Vocabulary(top.sort_values(["n", "word"], ascending=[False, True])["word"].to_numpy(np.int64).view(np.uint64))


def count(text: DataFrame, vocab, shards: int) -> DataFrame:
    """Trigrams of text (text), packed by shard, and sums for the driver: rows as ROW has them. vocab: a broadcast Vocabulary."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(codes: list) -> pa.RecordBatch:
            code, n = np.unique(np.concatenate(codes), return_counts=True)
            return _rows([(s, TRIGRAMS, 0, len(x), pack(code[x], n[x])) for s, x in _by(shard_of(code, shards))])

        codes, size = [], 0
        for batch in batches:
            for _, _, buf, offs in _parts(batch.column(0)):
                codes.append(vocab.value.trigrams(buf, offs)[0])
                size += len(codes[-1])
                if size > TOKENS:
                    yield out(codes)
                    codes, size = [], 0
        if size:
            yield out(codes)

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _shards(batches):
            code, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
            more, size = [(code, n)], 0
            for r in rows:
                more.append(unpack(r[4]))
                size += r[3]
                if size > TOKENS:
                    more, size = [_grouped(np.concatenate([m[0] for m in more]), np.concatenate([m[1] for m in more]))], 0
            code, n = _grouped(np.concatenate([m[0] for m in more]), np.concatenate([m[1] for m in more]))
            yield _rows([(shard, TRIGRAMS, 0, len(code), pack(code, n))])
            pair, before = _grouped(code & PAIR, np.ones(len(code), np.int64))
            row = _hot_row(pair >> BITS)
            # pairs of words that aren't hot are all here
            own = row < 0
            cell = np.concatenate([np.where(own, OTHERS, row) * ALL + (pair & LOW), COUNTS * ALL + np.arange(8)])
            sums = np.concatenate([np.where(own, 1, before), [(before[own] == k).sum() for k in (1, 2, 3, 4)], [(n == k).sum() for k in (1, 2, 3, 4)]])
            context = _hot_contexts(code)
            on = np.flatnonzero(context >= 0)
            cell = np.concatenate([cell, CONTEXTS * ALL + 4 * context[on], CONTEXTS * ALL + 4 * context[on] + np.minimum(n[on], 3)])
            cell, sums = _grouped(cell, np.concatenate([sums, n[on], np.ones(len(on), np.int64)]))
            yield _rows([(k, NUMBERS, 0, len(x), pack(cell[x], sums[x])) for k, x in _by(cell // (PART * ALL))])

    return _together(text.mapInArrow(local, ROW), shards).mapInArrow(merged, ROW)


def fit(trigrams: DataFrame) -> Model:
    """Of count()'s rows; the driver gets HEIGHT x ALL numbers at most, however much text there is."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, rows in _shards(batches):
            total = np.zeros(PART * ALL, np.int64)
            for r in rows:
                cell, n = unpack(r[4])
                total[cell - part * PART * ALL] += n
            cell = np.flatnonzero(total)
            yield _rows([(part, NUMBERS, 0, len(cell), pack(cell + part * PART * ALL, total[cell]))])

    table = np.zeros(HEIGHT * ALL, np.int64)
    for r in _together(trigrams.where(F.col("kind") == NUMBERS)).mapInArrow(add, ROW).select("blob").collect():
        cell, n = unpack(r.blob)
        table[cell] = n
    table = table.reshape(HEIGHT, ALL)
    hot = table[:OTHERS]
    two = [float(table[COUNTS, k] + (hot == k + 1).sum()) for k in range(4)]
    contexts = table[CONTEXTS:].reshape(-1)[: 4 * (HOT + 64) ** 2].reshape(-1, 4)
    return Model(two, table[COUNTS, 4:8].astype(float).tolist(), table[OTHERS] + (hot > 0).sum(axis=0), hot, contexts)


def score(docs: DataFrame, trigrams: DataFrame, vocab, model, shards: int) -> DataFrame:
    """doc_id, lang, th (hash of the text), n_tokens, nll (mean -ln P of a token; null without tokens) for every row of docs."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(held: list) -> pa.RecordBatch:
            about = pa.Table.from_batches([h[0] for h in held]).combine_chunks()
            n = np.concatenate([h[2] for h in held])
            code, doc = np.concatenate([h[1] for h in held]), np.repeat(np.arange(len(n)), n)
            th = about.column("th").to_numpy().view(np.uint64)
            # what a group of documents is called depends on these alone
            key = int(B.mix(np.array([np.bitwise_xor.reduce(B.mix(th + np.arange(len(th), dtype=np.uint64)))], np.uint64)).view(np.int64)[0])
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, about.schema) as w:
                w.write_table(about)
            whole = len(n).to_bytes(8, "little") + n.astype(np.int64).tobytes() + sink.getvalue().to_pybytes()
            rows = [(key % shards, DOCUMENTS, key, len(n), whole)]
            both, times = np.unique(code * len(n) + doc, return_counts=True)
            code, doc = both // len(n), both % len(n)
            for s, x in _by(shard_of(code, shards)):
                c, d = np.unique(code[x], return_counts=True)
                rows.append((s, ASKED, key, len(x), pack(c, d, doc[x], times[x])))
            return _rows(rows)

        held, size = [], 0
        for batch in batches:
            for i, j, buf, offs in _parts(batch.column(3)):
                code, n = vocab.value.trigrams(buf, offs)
                held.append((pa.RecordBatch.from_arrays([batch.column(k).slice(i, j - i) for k in range(3)], names=["doc_id", "lang", "th"]), code, n))
                size += len(code) + len(n)
                if size > TOKENS:
                    yield out(held)
                    held, size = [], 0
        if held:
            yield out(held)

    def answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _shards(batches):
            shard = None
            for _, kind, key, n, blob in rows:
                if kind == TRIGRAMS:
                    shard = Shard(model.value, *unpack(blob))
                elif kind == DOCUMENTS:
                    yield _rows([(key, DOCUMENTS, key, n, blob)])
                else:
                    code, d, doc, times = unpack(blob)
                    shard = shard or Shard(model.value, np.zeros(0, np.int64), np.zeros(0, np.int64))
                    cost = np.repeat(shard.cost(code), d) * times
                    order = np.argsort(doc, kind="stable")
                    doc = doc[order]
                    new = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
                    # in whole 2^-20ths: sums don't depend on their order
                    sums = np.add.reduceat(np.rint(cost[order] * (1 << 20)).astype(np.int64), new)
                    yield _rows([(key, SUMS, key, n, pack(doc[new], sums, np.add.reduceat(times[order], new)))])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _shards(batches):
            about: list[list] = []
            for _, kind, _, size, blob in rows:
                if kind == DOCUMENTS:
                    # one group's text may be there more than once
                    n = np.frombuffer(blob, np.int64, size, 8)
                    about.append([pa.ipc.open_stream(blob[8 * (size + 1) :]).read_all(), n, np.zeros(size, np.int64), np.zeros(size, np.int64)])
                else:
                    doc, sums, times = unpack(blob)
                    about[0][2][doc] += sums
                    about[0][3][doc] += times
            for table, n, _, _ in about:
                sums, times = about[0][2], about[0][3]
                if (times != n * len(about)).any():
                    raise RuntimeError("the order of the documents changed between two attempts of a task; store them first")
                nll = sums / np.maximum(times, 1) / (1 << 20)
                cols = [c.combine_chunks() for c in table.columns]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(n), pa.array(nll, pa.float64(), mask=n == 0)], names=["doc_id", "lang", "th", "n_tokens", "nll"])

    asked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang", F.xxhash64("text").alias("th"), "text").mapInArrow(ask, ROW)
    met = _together(trigrams.where(F.col("kind") == TRIGRAMS).unionByName(asked), shards).mapInArrow(answer, ROW)
    return _together(met).mapInArrow(total, "doc_id bigint, lang string, th bigint, n_tokens bigint, nll double")


def perplexity(docs: DataFrame, training: DataFrame) -> DataFrame:
    """score() of docs under a model of the texts of docs whose doc_id is in training (doc_id)."""
    spark = docs.sparkSession
    ids = training.where("doc_id is not null").select("doc_id").distinct()
    text = docs.select("doc_id", "text").join(small_enough(ids), "doc_id").select("text")
    size = text.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(1, math.ceil(size / SHARD_BYTES))
    vocab = spark.sparkContext.broadcast(vocabulary(text))
    with scratch(spark) as folder:
        trigrams = stored(count(text, vocab, shards), folder)
        model = spark.sparkContext.broadcast(fit(trigrams))
        scored = cut(score(docs, trigrams, vocab, model, shards))
    vocab.unpersist()
    model.unpersist()
    return scored


def classify(docs: DataFrame, trusted: DataFrame, quantile: float = 0.999, least: int = 20) -> DataFrame:
    """doc_id, lang, th, n_tokens, perplexity, threshold, kept for every row of docs.

    A fifth of the trusted documents, by crc32 of doc_id, is held out of the model. A document is kept if its mean -ln P is at most the
    given quantile over the held-out documents of its language and length class (powers of four tokens); where fewer than
    least of them are, over those of the length class in all languages, of the language, or over all. The quantile is estimated from the
    tail: the 0.9 quantile, and an exponential of the mean excess over it. A text shorter than the shortest length class of
    which least held-out documents are known can't be told and stays. Null and empty texts have no perplexity and aren't kept.
    Without held-out text everything else is. A null language is a language. Repeated rows give repeated results.
    """
    ids = trusted.where("doc_id is not null").select("doc_id").distinct()
    out = F.crc32(F.col("doc_id").cast("string")) % HELD_OUT == 0
    scored = perplexity(docs, ids.where(~out)).withColumn("class", F.expr("cast(ln(greatest(n_tokens, 1)) / ln(4) + 1e-9 as int)"))
    base = scored.where("nll is not null").join(small_enough(ids.where(out)), "doc_id", "left_semi")
    limits = cut(_limits(base.select("lang", "class", "nll"), quantile, least))
    # one row per language and class: small beside the documents; sides are broadcast only as their checked size allows
    fine = limits.where("level = 0").select(F.col("g_lang").alias("l0"), F.col("g_class").alias("c0"), F.col("limit").alias("t0"))
    broad = limits.where("level = 1").select(F.col("g_lang").alias("l1"), F.col("limit").alias("t1"))
    alike = limits.where("level = 2").select(F.col("g_class").alias("c2"), F.col("limit").alias("t2"))
    rest = limits.agg(F.max(F.when(F.col("level") == 3, F.col("limit"))).alias("t"), F.min(F.when(F.col("level") == 2, F.col("g_class"))).alias("shortest")).first()
    j = scored.join(small_enough(fine), F.col("lang").eqNullSafe(F.col("l0")) & (F.col("class") == F.col("c0")), "left")
    j = j.join(small_enough(alike), F.col("class") == F.col("c2"), "left")
    j = j.join(small_enough(broad), F.col("lang").eqNullSafe(F.col("l1")), "left")
    t = F.coalesce("t0", "t2", "t1", F.lit(rest["t"]).cast("double"))
    t = F.when(F.col("class") >= (rest["shortest"] or 0), t)
    kept = F.col("nll").isNotNull() & F.coalesce(F.col("nll") <= t, F.lit(True))
    return j.select("doc_id", "lang", "th", "n_tokens", F.exp("nll").alias("perplexity"), F.exp(t).alias("threshold"), kept.alias("kept"))


def _limits(base: DataFrame, quantile: float, least: int) -> DataFrame:
    """g_lang, g_class, level, limit: quantiles of base's nll by language and class (level 0), language (1), class (2) and over all (3)."""
    rows = base.select("nll", "lang", "class", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("level"))
    rows = rows.select("nll", "level", F.expr("if(level < 2, lang, null)").alias("g_lang"), F.expr("if(level % 2 = 0, class, null)").alias("g_class"))
    tails = rows.groupBy("level", "g_lang", "g_class").agg(F.percentile_approx("nll", F.lit(0.9), F.lit(10_000)).alias("q"), F.count(F.lit(1)).alias("n"))
    tails = tails.where((F.col("n") >= least) | (F.col("level") == 3)).select(F.col("level").alias("level"), F.col("g_lang").alias("k_lang"), F.col("g_class").alias("k_class"), "q")
    same = (rows["level"] == tails["level"]) & F.col("g_lang").eqNullSafe(F.col("k_lang")) & F.col("g_class").eqNullSafe(F.col("k_class"))
    both = rows.join(small_enough(tails), same).select(rows["level"], "g_lang", "g_class", "q", F.when(F.col("nll") > F.col("q"), F.col("nll") - F.col("q")).alias("over"))
    excess = F.coalesce(F.avg("over"), F.lit(0.0))
    return both.groupBy("level", "g_lang", "g_class").agg((F.max("q") + excess * math.log(0.1 / (1 - quantile))).alias("limit"))


def trusted_of(labels: DataFrame) -> DataFrame:
    return labels.where("quality = 1").select("doc_id")


def quality_filter(docs: DataFrame, trusted: DataFrame, **how) -> DataFrame:
    """docs without the rows that the classifier rejects (those with a null doc_id stay); columns as in docs."""
    return without(docs, classify(docs, trusted, **how).where("not kept").select("doc_id", "th"))
