import math
import os
import random
from collections import Counter

import brute
import numpy as np
import pytest
from brute import rows
from pyspark.sql import functions as F

from quillon.llm import bytesops, decontamination, licenses, mixing, quality, secrets, toxicity


def test_decontamination(docs, texts, items):
    want = brute.contaminated(texts, [tuple(r) for r in items.collect()])
    assert rows(decontamination.digest(docs, items)) == sorted(want, key=str)
    kept = decontamination.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [w[0] for w in want if not w[-1]]


def test_decontamination_edges(odd, empty, docs, items):
    assert rows(decontamination.digest(empty, items)) == []
    assert not any(r.contaminated for r in decontamination.digest(docs, items.limit(0)).collect())
    have = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert rows(decontamination.digest(odd, items)) == sorted(brute.contaminated(have, [tuple(r) for r in items.collect()]), key=str)
    own = odd.sparkSession.createDataFrame([(1, have[0][1])], "item_id bigint, text string")
    assert sorted(str(r.doc_id) for r in decontamination.digest(odd, own).where("contaminated").collect()) == ["1", "1", "3", "None"]
    assert sorted(str(r.doc_id) for r in decontamination.decontaminate(odd, own).collect()) == ["2", "3", "4", "None"]


def test_proximity(spark):
    d = spark.createDataFrame([(1, "x a c b d e y"), (2, "a b q q q q q q q q q q c d e"), (3, None)], "doc_id bigint, text string")
    b = spark.createDataFrame([(7, "a b c d e")], "item_id bigint, text string")
    assert {r.doc_id for r in decontamination.proximity(d, b, slop=2).collect()} == {1}


def test_proximity_against_all_stretches(spark):
    r = random.Random(5)
    w = [f"w{i}" for i in range(10)]
    common = lambda n: [r.choice(["w0", "w3", "w7", "q", "z"]) for _ in range(n)]
    texts = [w[::-1], [x for i in range(0, 10, 9) for x in [*w[i : i + 9], "foreign"]], [x for y in w for x in (y, "x")], [x for y in w for x in (y, "x", "x")]]
    for _ in range(60):
        x = r.sample(w, 10)
        for _ in range(r.randint(0, 14)):
            x.insert(r.randint(1, len(x) - 1), r.choice(["q", "z", "w3"]))
        texts.append(common(r.randint(0, 45)) + x + common(r.randint(0, 30)))
    items = {1: " ".join(w), 2: "w3 q z", 3: "w9"}
    want = set()
    for d, t in enumerate(texts):
        for i, x in items.items():
            span = len(x.split()) + 10
            if any(set(x.split()) <= set(t[p : p + span]) for p in range(len(t))):
                want.add((d, i))
    docs = spark.createDataFrame([(d, " ".join(t)) for d, t in enumerate(texts)] + [(900, None), (901, "")], "doc_id bigint, text string")
    bench = spark.createDataFrame(list(items.items()), "item_id bigint, text string")
    assert {(0, 1), (1, 1), (2, 1)} <= want and (3, 1) not in want
    got = decontamination.proximity(docs, bench).collect()
    assert {(x.doc_id, x.item_id) for x in got} == want
    for x in got:
        q = items[x.item_id].split()
        assert set(q) <= set(texts[x.doc_id][x.start : x.start + len(q) + 10])
    full = decontamination.report(docs, bench)
    assert rows(full.drop("n_near", "near_items")) == rows(decontamination.digest(docs, bench))
    full = full.collect()
    assert len(full) == len(texts) + 2 and all(x.n_near == len(list(filter(None, x.near_items.split(",")))) for x in full)
    assert {(x.doc_id, int(i)) for x in full for i in x.near_items.split(",") if i} == want


def test_secrets(docs, texts):
    got = {r.doc_id: r for r in secrets.digest(docs).collect()}
    for d, t in texts:
        b = brute.base_secrets(t)
        named = ",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in b)
        assert got[d].base_sha256 == brute.sha(named)
        assert [got[d].n_assign, got[d].n_access, got[d].n_hex] == [sum(x[1] == k for x in b) for k in range(3)]
        assert set(filter(None, named.split(","))) <= set(got[d].spans.split(","))


def test_battery_tells_keys_from_words(spark):
    r = np.random.default_rng(12)
    keys = ["".join(r.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), 40)) for _ in range(3)]
    plain = ["thisisalongordinarywordofthetext", "z" * 28, "internationalization-of-the-thing", "2024-01-01-2024-01-01-2024"] * 5
    text = [(i, f"so {t} it is") for i, t in enumerate(keys + plain)]
    got = {r.doc_id: r.spans for r in secrets.digest(spark.createDataFrame(text, "doc_id bigint, text string")).collect()}
    for i, k in enumerate(keys):
        assert got[i] == f"random:3:{3 + len(k)}"
    assert not any(got[i] for i in range(len(keys), len(text)))


def test_battery_statistics(spark):
    t = "0f1e2d3c4b5a69788796a5b4c3d2e1f0"
    r = secrets.battery(spark.createDataFrame([(t,)], "token string")).first()
    x = np.array([int(c, 16) + 1 for c in t], float)
    assert r.encoding == "hex" and r.n == 32
    assert abs(r.chi2 - sum((2 * np.ones(16) - 2) ** 2 / 2)) < 1e-9
    m = x - x.mean()
    assert abs(r.z_serial - (m[1:] * m[:-1]).sum() / (m * m).sum() * np.sqrt(32)) < 1e-9


def test_secrets_of_long_texts(spark):
    """Far more matches than are walked at once, among them none, and positions in code points; time grows with the text."""
    r = random.Random(4)
    part = lambda: r.choice(["é😀 ", "word ", "0123456789abcdef0 ", "AKIAABCDEFGHIJKLMN ", "token=abcdefghijkl0 ", "secret: short ", "%016x " % r.getrandbits(64)])
    texts = [(i, "".join(part() for _ in range(n))) for i, n in enumerate((0, 1, 255, 256, 257, 700, 3000))]
    texts.append((99, "%08x%08x " * 20000 % tuple(r.getrandbits(32) for _ in range(40000))))
    got = {x.doc_id: x for x in secrets.digest(spark.createDataFrame(texts, "doc_id bigint, text string")).collect()}
    for d, t in texts:
        assert got[d].base_sha256 == brute.sha(",".join(f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in brute.base_secrets(t)))


def test_discoveries_are_those_of_benjamini_and_hochberg(spark):
    r = np.random.default_rng(3)
    for share in (0.0, 0.1, 0.9):
        chance = np.where(r.random(400) < share, 10.0 ** -r.uniform(2, 14, 400), r.random(400))
        ok = r.random(400) < 0.8
        df = spark.createDataFrame([(i, float(c), bool(o)) for i, (c, o) in enumerate(zip(chance, ok, strict=True))], "i int, chance double, random boolean")
        # as coarse as the grid: chances count as the next higher 1/40 of a decade
        p = [10 ** (-math.floor(-math.log10(max(c, 1e-12)) * secrets.GRID) / secrets.GRID) if o else math.inf for c, o in zip(chance, ok, strict=True)]
        ranked = sorted(p)
        k = max([i for i in range(1, 401) if ranked[i - 1] <= 0.05 * i / 400 * (1 + 1e-12)], default=0)
        want = {i for i in range(400) if k and p[i] <= ranked[k - 1]}
        assert {x.i for x in secrets.discoveries(df).collect()} == want and bool(want) == (share > 0)


def test_normal_tails(spark):
    z = [-8.0, -5.0, -2.0, -0.5, 0.0, 1.0, 4.0]
    got = spark.createDataFrame([(x,) for x in z], "z double").select("z", secrets._phi(F.col("z")).alias("p")).collect()
    assert all(abs(x.p / (math.erfc(-x.z / math.sqrt(2)) / 2) - 1) < 5e-3 for x in got)


def test_secrets_edges(odd, empty):
    assert rows(secrets.digest(empty)) == []
    none = brute.sha("")
    assert rows(secrets.digest(odd)) == sorted([(i, 0, 0, 0, none, "") for i in (None, None, 1, 1, 2, 3, 3, 4)], key=str)


def test_automaton_against_all_substrings():
    r = np.random.default_rng(3)
    seqs = [r.integers(0, 4, n).tolist() for n in (30, 17, 30, 1)]
    a = licenses.Automaton(seqs)
    subs = {}
    for t, s in enumerate(seqs):
        for i in range(len(s)):
            for j in range(i + 1, len(s) + 1):
                subs.setdefault(tuple(s[i:j]), {}).setdefault(t, set()).add(j - 1)
    text = r.integers(0, 5, 200).tolist()
    longest = [max([n for n in range(0, 31) if n <= i + 1 and (n == 0 or tuple(text[i + 1 - n : i + 1]) in subs)]) for i in range(200)]
    want = [(i + 1 - n, n) for i, n in enumerate(longest) if n >= 2 and (i == 199 or longest[i + 1] != n + 1)]
    got = a.matches(text, 2)
    assert [g[:2] for g in got] == want
    for s, n, v in got:
        assert a.ends[v] == subs[tuple(text[s : s + n])]


def test_licenses(docs, texts):
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    for d, t in texts:
        n, places = brute.phrases(t, licenses.PHRASES)
        r = got[d]
        assert (r.n_words, r.n_base) == (n, len(places))
        assert (r.first_word, r.last_word) == ((places[0][0], places[-1][0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x[1] for x in places}))
        assert set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) and 0 <= r.score <= 1


def test_license_spans(spark):
    mit = licenses.TEMPLATES["mit-notice"]
    cut = mit.split()
    broken = " ".join(cut[:40] + ["XX"] * 3 + cut[44:])
    t = [(1, f"foo {mit.upper()} bar"), (2, f"foo bar {broken}"), (3, "the software and the use of the copies"), (4, "GNU General, Public License; CC BY MIT license")]
    got = {r.doc_id: r for r in licenses.scan(spark.createDataFrame(t, "doc_id bigint, text string")).collect()}
    one = next(s for s in got[1].spans if s.label == "mit-notice")
    assert (one.first, one.last, one.share) == (1, len(cut), 1.0)
    two = next(s for s in got[2].spans if s.label == "mit-notice")
    assert two.first == 2 and two.share > 0.9
    assert got[3].labels == "" and got[4].base_labels == "cc-by,gpl,mit" and got[4].n_base == 3


def test_chains_against_all_sequences_of_places():
    r = np.random.default_rng(11)
    some = 0
    for _ in range(60):
        places = [(int(f), int(t), int(n)) for f, t, n in zip(r.integers(4, 40, 9), r.integers(4, 25, 9), r.integers(1, 5, 9), strict=True)]

        def grow(chain, covered, left):
            yield covered, chain[-1][0], chain[0][0] - chain[0][2] + 1
            f, t, _ = chain[-1]
            for x in left:
                if x[0] > f and x[1] > t and x[0] - x[2] - f <= 6:
                    yield from grow([*chain, x], covered + min(x[2], x[0] - f, x[1] - t), left)

        whole = max((c, -last, -first) for x in places for c, last, first in grow([x], x[2], places))
        got = licenses.chains(places, 6)
        assert whole in [(c, -last, -first) for first, last, c in got] and max(c for _, _, c in got) == whole[0]
        assert all(a[1] < b[0] for a, b in zip(got, got[1:], strict=False))
        some += len(got) > 1
    assert some


def test_license_shares_against_plain_search(spark):
    """Random templates full of repeated phrases, in files that hold them with gaps and changes."""
    r = np.random.default_rng(2)
    templates = {f"t{k}": " ".join(r.choice(["a", "b", "c", "d e", "f g h"], 14)) for k in range(4)}
    files = []
    for i in range(60):
        w = " ".join(templates[f"t{k}"] for k in r.choice(4, 2)).split()
        for at in r.choice(len(w), 5, replace=False):
            w[at] = r.choice(["x", "y z", "a", "c x x x x x x x x x x x x x x"])
        files.append((i, " ".join(w)))
    got = {x.doc_id: x for x in licenses.scan(spark.createDataFrame(files, "doc_id bigint, text string"), templates, {}, least=3, gap=4, share=0.5).collect()}
    seen = set()
    for i, text in files:
        w, best = text.split(), {}
        for k, t in templates.items():
            q = t.split()
            runs = {(a, b): n for a in range(len(w)) for b in range(len(q)) for n in range(min(len(w) - a, len(q) - b), 0, -1) if w[a : a + n] == q[b : b + n]}
            # the longest run of any template that ends at a word of the file, if the next word doesn't prolong it
            runs = [(a, b, n) for (a, b) in runs for n in range(1, min(len(w) - a, len(q) - b) + 1) if w[a : a + n] == q[b : b + n]]
            best[k] = runs
        longest = [max([n for v in best.values() for a, _, n in v if a + n - 1 == e] or [0]) for e in range(len(w))]
        for k, t in templates.items():
            q = t.split()
            places = sorted((a + n - 1, b + n - 1, n) for a, b, n in best[k] if n >= 3 and n == longest[a + n - 1] and (a + n == len(w) or longest[a + n] <= n))
            cover = []
            for j, (f, u, n) in enumerate(places):
                cover.append(max([n] + [cover[p] + min(n, f - g, u - v) for p, (g, v, _) in enumerate(places[:j]) if g < f and v < u and f - n - g <= 4]))
            share = max(cover, default=0) / len(q)
            mine = [s.share for s in got[i].spans if s.label == k]
            assert max(mine, default=0) == (share if share >= 0.5 else 0)
            assert (k in got[i].labels.split(",")) == (share >= 0.5)
            seen.add(share >= 0.5)
    assert seen == {True, False}


def test_notices_keep_their_label_with_changed_words_and_lose_it_when_sparse(spark):
    files, want = [], {}
    for k, t in licenses.TEMPLATES.items():
        w = t.split()
        if len(w) < 30:
            continue
        r = random.Random(k)
        for _ in range(6):
            x = list(w)
            for at in r.sample(range(len(w)), 2):
                x[at] = "zzz"
            want[len(files)] = (k, True)
            files.append((len(files), " ".join(x)))
        want[len(files)] = (k, False)
        files.append((len(files), " ".join(x if i % 15 < 3 else "zzz" for i, x in enumerate(w))))
    w = licenses.TEMPLATES["gpl-notice"].split()
    want[len(files)] = ("gpl-notice", True)
    files.append((len(files), " ".join("zzz" if i in (41, 45) else x for i, x in enumerate(w))))
    for x in licenses.scan(spark.createDataFrame(files, "doc_id bigint, text string")).collect():
        k, there = want[x.doc_id]
        assert (k in x.labels.split(",")) == there, (k, x.labels)
        # a short notice may share three words of eight with a long one
        assert there or x.n_base or x.score < 0.6


def test_license_edges(odd, empty):
    assert rows(licenses.digest(empty)) == []
    have = [tuple(r) for r in odd.select("doc_id", "text").collect()]
    assert rows(licenses.digest(odd)) == sorted([(d, len(brute.words(t)), 0, None, None, "", "", 0.0) for d, t in have], key=str)


def test_segments_are_maximal():
    r = np.random.default_rng(9)
    for n in (0, 1, 5, 60):
        for _ in range(40):
            x = r.integers(-3, 4, n).astype(float)
            got = toxicity.segments(x)

            def ruzzo(lo, hi):
                c = [(x[i:j].sum(), -(j - i), -i, i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)]
                if not c or max(c)[0] <= 0:
                    return []
                v, _, _, i, j = max(c)
                return ruzzo(lo, i) + [(i, j, v)] + ruzzo(j, hi)

            assert abs(max([0.0, *(g[2] for g in got)]) - toxicity.best(x)) < 1e-9
            assert abs(sum(g[2] for g in got) - sum(w[2] for w in ruzzo(0, n))) < 1e-9
            assert all(a[1] <= b[0] for a, b in zip(got, got[1:], strict=False))


def test_segments_against_repeated_search():
    """Without ties, the maximal segments are the best one, and those of what lies before and after it."""
    r = np.random.default_rng(10)

    def best_first(x, lo, hi):
        c = [(x[i:j].sum(), i, j) for i in range(lo, hi) for j in range(i + 1, hi + 1)]
        if not c or max(c)[0] <= 0:
            return []
        v, i, j = max(c)
        return [*best_first(x, lo, i), (i, j, v), *best_first(x, j, hi)]

    for n in (1, 2, 8, 25):
        for _ in range(40):
            x = r.normal(-0.2, 1, n)
            got, want = toxicity.segments(x), best_first(x, 0, n)
            assert [g[:2] for g in got] == [w[:2] for w in want]
            assert all(abs(g[2] - w[2]) < 1e-9 for g, w in zip(got, want, strict=True))


def test_toxicity_model_against_plain_counts(spark):
    import zlib

    r = np.random.default_rng(2)
    common = [f"word{i}" for i in range(30)] + ["a", "bé", "longerword"]
    texts = {i: " ".join([*r.choice(common, 25), *(r.choice(["nasty", "nastiest", "awful"], 3) if i % 5 == 0 else [])]) for i in range(400)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    labels = spark.createDataFrame([(i, int(i % 5 == 0)) for i in texts], "doc_id bigint, toxic int")
    m = toxicity.fit(docs, labels)
    train = {i: t for i, t in texts.items() if zlib.crc32(str(i).encode()) % 5}

    def keys(w):
        b = np.frombuffer(w.encode(), np.uint8)
        start = lambda k: int(bytesops.hashes(b, np.zeros(1, np.int64), np.array([min(k, len(b))]))[0])
        return [start(len(b)), *(start(k) ^ k for k in toxicity.STEMS)]

    y = [Counter(), Counter()]
    for i, t in train.items():
        y[i % 5 == 0].update(set().union(*(keys(w) for w in brute.words(t))))
    t0, t1 = (sum(c.values()) for c in y)
    want = {}
    for k in set(y[0]) | set(y[1]):
        n = y[0][k] + y[1][k]
        a1, a0, total = y[1][k] + toxicity.PRIOR * n, y[0][k] + toxicity.PRIOR * n, toxicity.PRIOR * (t1 + t0)
        d = math.log(a1 / (t1 + total - a1)) - math.log(a0 / (t0 + total - a0))
        if n >= 5 and abs(d) / math.sqrt(1 / a1 + 1 / a0) >= toxicity.SIGNIFICANT:
            want[k] = d
    got = dict(zip(m.buckets.tolist(), m.scores.tolist(), strict=True))
    assert set(got) == set(want) and all(abs(got[k] - want[k]) < 1e-9 for k in want) and len(want) > 3
    # K: clean texts with a segment, over what chance weighs them with
    x = {i: m.of(np.array([keys(w) for w in brute.words(t)], np.uint64)) for i, t in train.items() if i % 5}
    s = {i: toxicity.best(v) for i, v in x.items()}
    assert abs(m.k - max(0.5, sum(v > 0 for v in s.values())) / sum(len(x[i]) * math.exp(-m.lam * s[i]) for i in s)) < 1e-9


def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.isdir(sf):
        pytest.skip("the public tables aren't here")
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    x = toxicity.digest(docs, labels).join(labels.select("doc_id", "toxic"), "doc_id").where("held_out").collect()
    assert len(x) > 50 and sum(r.predicted == r.toxic for r in x) >= 0.93 * len(x)


def test_toxicity_learns_and_ignores_the_rest(spark):
    r = np.random.default_rng(1)
    words = ["alpha", "beta", "gamma", "delta", "epsilon"]
    rows_, labels = [], []
    for i in range(400):
        bad = i % 4 == 0
        w = list(r.choice(words, 30)) + (["vile", "rotten"] if bad else [])
        rows_.append((i, " ".join(r.permutation(w))))
        labels.append((i, 1, int(bad)))
    rows_ += [(1000, None), (1001, ""), (None, "vile")]
    labels += [(None, 1, 1), (2, 1, None)]
    docs = spark.createDataFrame(rows_, "doc_id bigint, text string")
    lab = spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")
    got = {x.doc_id: x for x in toxicity.score(docs, toxicity.fit(docs, lab)).collect()}
    assert all(got[i].predicted == (i % 4 == 0) for i in range(400))
    assert all(0 <= x.score <= 1 for x in got.values()) and got[1000].score == got[1001].score < 0.5
    import zlib

    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(400))
    assert got[0].passages and not got[1].passages
    one = toxicity.digest(docs, lab.where("toxic = 0"))
    assert {x.predicted for x in one.collect()} == {0}
    assert toxicity.digest(docs.limit(0), lab).count() == 0 and toxicity.digest(docs, lab.limit(0)).count() == len(rows_)


def test_tokens_of_the_language_model():
    t = ["Go go GO go on, on... 12 ###", "", "a b"]
    buf = np.frombuffer("".join(t).encode(), np.uint8)
    h, other, n = quality.tokens(buf, np.cumsum([0] + [len(x) for x in t]))
    assert n.tolist() == [10, 0, 2]
    assert other.tolist()[:4] == [quality.KINDS + 2, -quality.RUNS - 1, -quality.RUNS - 2, -quality.RUNS - 3]
    assert other.tolist()[4:10] == [quality.KINDS + 2, quality.KINDS + 24, quality.KINDS + 2, quality.KINDS + 24 + 3, quality.KINDS + 16 + 2, quality.KINDS + 24 + 3]
    assert h[4] == h[6] != h[0]


def test_packed_numbers_come_back():
    r = np.random.default_rng(3)
    for n in (0, 1, 1000):
        x = [np.sort(r.integers(0, 1 << 42, n)), r.integers(0, 9, n), r.integers(0, 1 << 40, n // 2)]
        assert all((a == b).all() and len(a) == len(b) for a, b in zip(x, quality.unpack(quality.pack(*x)), strict=True))


def test_quality_against_plain_counts(spark, monkeypatch):
    """Few hot words, many shards and small groups of documents, so that all that is split is put together again."""
    r = np.random.default_rng(8)
    words = [f"w{i}" for i in range(60)] + ["\u00e9t\u00e9", ",", "!!", "UP", "42"]
    p = 1 / np.arange(1, len(words) + 1)
    docs = [(i, " ".join(r.choice(words, r.integers(0, 120), p=p / p.sum())), ["en", "de", None][i % 3]) for i in range(240)]
    docs += [(300, None, "en"), (301, "zz " * 50, "en"), (302, "", None), (303, "w1 " * 40000, "de")]
    trusted = set(range(0, 200))
    df = spark.createDataFrame(docs, "doc_id bigint, text string, lang string").repartition(5)
    ids = spark.createDataFrame([(i,) for i in trusted], "doc_id bigint")
    want = brute.quality(docs, trusted)
    for size in (1 << 21, 50):
        monkeypatch.setattr(quality, "TOKENS", size)
        monkeypatch.setattr(quality, "SHARD_BYTES", 1 << 20 if size > 50 else 1000)
        got = {x.doc_id: x for x in quality.classify(df, ids).collect()}
        for i, (n, nll, limit, kept) in want.items():
            assert (got[i].n_tokens, got[i].kept) == (n, kept)
            assert (got[i].perplexity is None) == (nll is None) and (nll is None or abs(math.log(got[i].perplexity) - nll) < 1e-5)
            assert (got[i].threshold is None) == (limit is None) and (limit is None or abs(math.log(got[i].threshold) - limit) < 1e-4)
    again = quality.perplexity(df.unionByName(df), ids).collect()
    assert len(again) == 2 * len(docs) and all((x.nll is None) == (want[x.doc_id][1] is None) for x in again)


def test_quality(spark):
    r = np.random.default_rng(6)
    syl = ["the", "an", "re", "ti", "on", "es"]
    word = lambda: "".join(r.choice(syl, r.integers(1, 4)))
    good = [(i, " ".join(word() for _ in range(40)) + ".") for i in range(300)]
    bad = [(1000 + i, " ".join([word()] * 40)) for i in range(10)] + [(2000 + i, " ".join(word() + "###" for _ in range(40))) for i in range(10)]
    other = [(3000, None), (3001, ""), (3002, "ok"), (None, "the an re")]
    df = spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, 1) for i, t in good + bad + other], "doc_id bigint, text string, lang string, threshold int")
    trusted = spark.createDataFrame([(i,) for i in range(0, 300, 2)] + [(None,)], "doc_id bigint")
    got = {x.doc_id: x for x in quality.classify(df, trusted).collect()}
    assert sum(got[i].kept for i, _ in good) >= 299 and not any(got[i].kept for i, _ in bad)
    assert not got[3000].kept and got[3001].perplexity is None and got[3002].kept
    out = quality.quality_filter(df, trusted)
    assert out.columns == df.columns and {x.doc_id for x in out.collect()} == {i for i, x in got.items() if x.kept} | {None}
    assert quality.classify(df.limit(0), trusted).count() == 0
    assert quality.classify(df, trusted.limit(0)).where("kept").count() == len(good + bad + other) - 2


def test_pfair_plan(spark):
    s = spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.15), (None, 0.05), ("z", 0.0)], "source string, target double")
    p = mixing.plan(s, 100).orderBy("slot").collect()
    q = {r.source: r.q for r in p}
    assert sum(q.values()) == 100 and "z" not in q
    order = sorted(q, key=lambda x: (x is not None, x or ""))
    assert [order.index(r.source) for r in p] == brute.pfair({i: q[x] for i, x in enumerate(order)}, 100, 1)
    done = dict.fromkeys(q, 0)
    for t, r in enumerate(p, 1):
        done[r.source] += 1
        assert all(abs(done[x] - t * q[x] / 100) < 1 for x in q)


def test_mixing(docs, texts, odd, empty):
    got = mixing.mix(docs, block=2, cycle=50).collect()
    assert sorted(r.doc_id for r in got) == [i for i, _ in texts]
    assert len({(r.slot, r.place) for r in got}) == len(got)
    assert all(r.release <= r.slot < r.deadline for r in got)
    for s in {r.source for r in got}:
        assert sorted(r["rank"] for r in got if r.source == s) == list(range(sum(r.source == s for r in got)))
    assert mixing.mix(empty).count() == 0
    # one source, the null one
    got = mixing.mix(odd).collect()
    assert sorted((r.slot, r.place) for r in got) == [(0, i) for i in range(8)] and {r.source for r in got} == {None}
    some = mixing.mix(docs, docs.sparkSession.createDataFrame([("s0", 1.0), ("s1", 3.0)], "source string, target double"))
    assert {r.source for r in some.collect() if r.slot is None} == {"s2"}


def test_mixing_follows_the_targets_themselves(spark):
    """A hot source among hundreds, over many cycles, and a source that gets less than a slot a cycle."""
    s = [("hot", 100.0, 60)] + [(f"s{i:03d}", 10.0 if i else 0.7, 6) for i in range(120)]
    p = mixing.plan(spark.createDataFrame(s, "source string, target double, blocks bigint"), 100).orderBy("slot").collect()
    target = {x: t / sum(y[1] for y in s) for x, t, _ in s}
    assert [r.slot for r in p] == list(range(len(p))) and len(p) > 20 * 100
    done = dict.fromkeys(target, 0)
    for t, r in enumerate(p, 1):
        done[r.source] += 1
        assert abs(done[r.source] - t * target[r.source]) < 1 + 1e-6
    assert all(done[x] >= b for x, _, b in s)
    docs = spark.range(1000).selectExpr("id as doc_id", "if(id < 900, 'hot', concat('s', id % 50)) as source")
    got = mixing.mix(docs, block=2, cycle=60).collect()
    w = {x: math.sqrt(n) for x, n in Counter(r.source for r in got).items()}
    for r in got:
        share = w[r.source] / sum(w.values())
        assert r.release <= r.slot < r.deadline and abs(r.release - math.floor(r.block / share)) <= 1 and abs(r.deadline - math.ceil((r.block + 1) / share)) <= 1


def test_groups_cover_all_texts():
    offs = np.array([0, 10, 10, 5000, 5001, 9000])
    got = list(bytesops.groups(offs, 100))
    assert got[0][0] == 0 and got[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(got, got[1:], strict=False))
