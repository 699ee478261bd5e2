import brute
import numpy as np
import pytest
from brute import rows
from pyspark.sql import functions as F

from quillon.llm import components, linededup, neardedup, suffixdedup, vectordedup


def test_two_stage_sort_is_a_suffix_array():
    rng = np.random.default_rng(1)
    for n in (1, 2, 7, 400, 3000):
        for k in (1, 2, 4, 250):
            t = rng.integers(0, k, n).astype(np.uint8)
            sa, word = suffixdedup.two_stage(t, 100)
            s = bytes(t) + bytes(120)
            assert sorted(sa.tolist()) == list(range(n))
            got = [bytes(t)[i : i + 100] for i in sa]
            assert got == sorted(got)
            shared = suffixdedup.common_prefixes(sa, word, 100)
            assert shared.tolist() == [next((i for i in range(100) if s[a + i] != s[b + i]), 100) for a, b in zip(sa[:-1], sa[1:], strict=True)]
            same = suffixdedup.equal_neighbours(sa, word, 100)
            assert same.tolist() == [s[a : a + 100] == s[b : b + 100] for a, b in zip(sa[:-1], sa[1:], strict=True)]


@pytest.mark.parametrize("many", [2000, 2])
def test_suffix_dedup(docs, texts, many):
    got = rows(suffixdedup.digest(docs, many=many))
    assert got == sorted(brute.spans_removed(texts), key=str)


def test_suffix_dedup_of_a_text_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffixdedup, "PIECE", 512)
    monkeypatch.setattr(suffixdedup, "SLICE", 1024)
    r = np.random.default_rng(5)
    base = "".join(chr(97 + x) for x in r.integers(0, 5, 3000))
    t = [(1, base + base[100:900]), (2, base[500:1200] + "zz" + base[50:400]), (3, base)]
    buf, offs = np.frombuffer("".join(x for _, x in t).encode(), np.uint8), np.cumsum([0] + [len(x) for _, x in t])
    # every string is in one block, whatever the pieces
    seen = set()
    for _, _, d, s, c in suffixdedup._pieces(buf, offs, 100):
        for a, b, n in zip(d, s, c, strict=True):
            for k in range(n):
                assert (a, b + k) not in seen
                seen.add((a, b + k))
    assert len(seen) == sum(len(x) - 99 for _, x in t)


def test_suffix_dedup_edges(odd, empty):
    assert rows(suffixdedup.digest(empty)) == []
    got = suffixdedup.digest(odd).collect()
    assert len(got) == 8
    assert all(r.n_removed == 0 for r in got if r.doc_id is None)


def test_line_dedup(docs, texts):
    want = brute.lines_kept(texts)
    got = {r.doc_id: r for r in linededup.digest(docs).collect()}
    for i, (d, _) in enumerate(texts):
        lines, kept = want[i]
        assert (got[d].n_lines, got[d].n_dropped, got[d].kept_sha256) == (len(lines), len(lines) - len(kept), brute.sha("\n".join(kept)))
    assert sum(r.n_dropped for r in got.values()) > 0
    whole = linededup.line_dedup(docs)
    assert whole.columns == docs.columns
    for r in whole.collect():
        lines, kept = want[r.doc_id]
        assert r.text == ("\n".join(kept) if len(kept) < len(lines) else texts[r.doc_id][1])
        assert r.n_chars == (None if r.text is None else len(r.text))


def test_line_dedup_over_words_of_a_bitmap(spark):
    many = [(d, "\n".join(f"line number {i} of document {d if i % 3 else 0} at some length" for i in range(300))) for d in range(4)]
    df = spark.createDataFrame(many, "doc_id bigint, text string")
    want = brute.lines_kept(many)
    for r in linededup.digest(df).collect():
        assert r.kept_sha256 == brute.sha("\n".join(want[r.doc_id][1]))


def test_line_dedup_counts_doc_ids_and_splits_hot_keys(spark, monkeypatch):
    """Keys of a few documents and of most, decided in both ways; a doc_id with two rows is one document."""
    line = [f"line number {i} is long enough" for i in range(8)]
    texts = [(1, line[0]), (1, line[0]), (2, line[0]), (3, "\n".join(line[1:]) + "\n" + line[1].upper())]
    texts += [(10 + i, "\n".join([*line[1 : 2 + i % 7], line[1], "own line of document %d here" % i])) for i in range(30)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string").repartition(4)
    got = {}
    for hot in (1000, 2, 1):
        monkeypatch.setattr(linededup, "HOT", hot)
        got[hot] = rows(linededup.digest(df))
    assert got[1000] == got[2] == got[1] and all(r[2] == 0 for r in got[2] if r[0] < 3)
    want = brute.lines_kept(texts[3:])
    assert {r[0]: r[3] for r in got[2] if r[0] > 2} == {d: brute.sha("\n".join(want[i][1])) for i, (d, _) in enumerate(texts[3:])}
    assert next(r for r in got[2] if r[0] == 3)[4] == "0:" + str(0b11111111)


def test_line_dedup_edges(odd, empty):
    assert rows(linededup.digest(empty)) == []
    got = linededup.digest(odd).collect()
    assert len(got) == 8
    # five rows hold the line; those of the largest id that does keep it
    assert sorted((str(r.doc_id), r.n_dropped) for r in got) == [("1", 1), ("1", 1), ("2", 0), ("3", 0), ("3", 0), ("4", 0), ("None", 0), ("None", 1)]
    assert linededup.line_dedup(odd).count() == 8


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(2)
    sets = []
    for n in (1, 3, 40, 900, 5000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n - n // 5], rng.integers(0, 1 << 63, n // 5, dtype=np.uint64)]))
        sets += [a, b]
    sig = neardedup.superminhash(sets)
    assert (sig != neardedup._FREE).all()
    for i in range(0, len(sets), 2):
        a, b = set(sets[i].tolist()), set(sets[i + 1].tolist())
        assert abs((sig[i] == sig[i + 1]).mean() - len(a & b) / len(a | b)) < 0.12
    # alone or among others, a set has the same signature; every slot of one element's is another draw
    assert (neardedup.superminhash(sets[3:4]) == sig[3]).all()
    assert sorted(int(x) >> 32 for x in sig[0]) == list(range(sig.shape[1]))


def test_near_duplicates(docs, texts):
    assert rows(neardedup.near_duplicates(docs)) == sorted(brute.near_duplicates(texts), key=str)
    kept = neardedup.near_dedup(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [d for d, _, _, k in brute.near_duplicates(texts) if k]


def test_near_duplicates_in_a_chain(spark):
    """Each is near the next one only: the group is found although its ends aren't alike."""
    w = [f"w{i}" for i in range(140)]
    texts = [(i, " ".join(w[i * 4 : i * 4 + 60])) for i in range(20)]
    df = spark.createDataFrame(texts[::-1], "doc_id bigint, text string")
    assert rows(neardedup.near_duplicates(df)) == sorted(brute.near_duplicates(texts), key=str)


def test_no_pair_is_compared_twice(spark, monkeypatch):
    """Texts of one template, alike enough to share buckets and too unlike to be linked."""
    r = np.random.default_rng(7)
    frame = [f"f{i}" for i in range(80)]
    texts = [(i, " ".join(w if j % 9 or j == 0 else f"x{r.integers(1 << 30)}" for j, w in enumerate(frame))) for i in range(60)]
    compared = []
    verify = neardedup._verify

    def counted(pairs, *how):
        compared.extend((x.a, x.b) for x in pairs.collect())
        return verify(pairs, *how)

    monkeypatch.setattr(neardedup, "_verify", counted)
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert rows(neardedup.near_duplicates(df)) == sorted(brute.near_duplicates(texts), key=str)
    assert compared and len(compared) == len(set(compared)) <= 60 * 59 // 2


def test_near_duplicates_edges(odd, empty):
    assert rows(neardedup.near_duplicates(empty)) == []
    got = rows(neardedup.near_duplicates(odd), "doc_id", "n_shingles", "component_id", "kept")
    assert len(got) == 8
    assert [r for r in got if r[0] is None] == sorted([(None, 12, None, True), (None, 0, None, True)], key=str)
    assert [r for r in got if r[0] in (2, 4)] == [(2, 0, 2, True), (4, 0, 4, True)]
    assert (3, 12, 1, False) in got and (3, 3, 3, True) in got


def test_components(spark):
    r = np.random.default_rng(0)
    links = [tuple(map(int, x)) for x in r.integers(0, 300, (200, 2))] + [(1000 + i, 1001 + i) for i in range(60)]
    want = brute.components(1100, links)
    for few in (0, components.FEW):
        got = {x.id: x.component for x in components.components(spark.createDataFrame(links, "a bigint, b bigint"), few).collect()}
        assert got == {i: want[i] for e in links if e[0] != e[1] for i in e}
    assert components.components(spark.createDataFrame([(1, 1), (None, 2)], "a bigint, b bigint")).count() == 0


def test_vectors(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(60, 12))
    near = base[:30] + r.normal(size=(30, 12)) * 0.25
    v = [list(map(float, x)) for x in np.concatenate([base, near, base[:5], base[5:8] * 3])]
    v += [None, [], [0.0] * 12, [float("nan")] * 12, [float("inf")] + [1.0] * 11, [None] + [1.0] * 11, [1.0, 2.0]]
    v = [None if x is None else [None if y is None else float(np.float32(y)) for y in x] for x in v]
    df = spark.createDataFrame([(i, x, 7, "z") for i, x in enumerate(v)], "vec_id bigint, embedding array<float>, label int, n string")
    want = brute.vectors(list(enumerate(v)))
    for block in (8192, 16):
        assert rows(vectordedup.near_duplicate_vectors(df, block=block)) == sorted(want, key=str)
    assert vectordedup.near_duplicate_vectors(df.limit(0)).count() == 0
    null = df.select(F.lit(None).cast("bigint").alias("vec_id"), "embedding").limit(3)
    assert [tuple(r) for r in vectordedup.near_duplicate_vectors(null).collect()] == [(None, 0, None, True)] * 3


def test_vectors_of_any_type_and_of_several_lengths(spark, monkeypatch):
    r = np.random.default_rng(5)
    v = [list(map(float, x)) for d, n in ((3, 60), (2, 40), (7, 5), (1, 3)) for x in r.normal(size=(n, d))]
    v += [[1.0, 2.0], [1.0, 2.0], [0.0, -0.0], [-0.0, 1.0], [0.0, 1.0], None]
    want = sorted(brute.vectors(list(enumerate(v))), key=str)
    assert any(w[1] for w in want if len(v[w[0]] or []) == 2)
    monkeypatch.setattr(vectordedup, "LEAST", 30)
    for kind in ("double", "float"):
        df = spark.createDataFrame(list(enumerate(v)), f"vec_id bigint, embedding array<{kind}>")
        for block in (None, 8):
            assert rows(vectordedup.near_duplicate_vectors(df, block=block)) == want
    whole = spark.createDataFrame([(1, [1, 2]), (2, [2, 4]), (3, [1, -2])], "vec_id bigint, embedding array<int>")
    assert rows(vectordedup.near_duplicate_vectors(whole)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]
