"""The whole pipeline against plain versions of its stages, on the smallest tables."""

import hashlib
import math
import os
from collections import Counter, defaultdict

import brute
import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the public tables aren't here")


def schedule(docs, block=8):
    """Earliest deadline first by the exact shares of the sources, as ratios of whole numbers."""
    by = defaultdict(list)
    for d in docs:
        by[d["source"]].append(d["doc_id"])
    names = sorted(by)
    blocks = {s: -(-len(by[s]) // block) for s in names}
    root = {s: math.sqrt(len(by[s])) for s in names}
    total = math.fsum(root.values())
    most = max(1000.0, *(blocks[s] * total / root[s] for s in names)) + 2
    scale = 10.0 ** min(15, math.floor(math.log10(4e18 / most)))
    w = {s: round(root[s] / total * scale) for s in names}
    g = math.gcd(*w.values())
    w = {s: v // g for s, v in w.items()}
    c = sum(w.values())
    k, slots, t = dict.fromkeys(names, 0), defaultdict(list), 0
    while t < min(c, max(-(-blocks[s] * c // w[s]) for s in names)):
        s = min((-(-(k[s] + 1) * c // w[s]), s) for s in names if k[s] * c <= t * w[s])[1]
        slots[s].append(t)
        k[s] += 1
        t += 1
        assert all(abs(k[s] - t * w[s] / c) < 1 for s in names)
    out = []
    for s, ids in by.items():
        for r, i in enumerate(sorted(ids, key=lambda i: (hashlib.md5(str(i).encode()).hexdigest(), i))):
            b = r // block
            out.append((i, s, r, b, b * c // w[s], -(-(b + 1) * c // w[s]), slots[s][b], r % block))
    return out


def test_pipeline(spark):
    docs = [r.asDict() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    trusted = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {i for i, x in brute.quality([(d["doc_id"], d["text"], d["lang"]) for d in docs], trusted).items() if x[-1]}
    docs = [d for d in docs if d["doc_id"] in kept]
    lines = brute.lines_kept([(d["doc_id"], d["text"]) for d in docs])
    docs = [d | {"text": "\n".join(lines[i][1])} for i, d in enumerate(docs)]
    near = {d for d, _, _, k in brute.near_duplicates([(d["doc_id"], d["text"]) for d in docs]) if k}
    docs = [d for d in docs if d["doc_id"] in near]
    clean = {c[0] for c in brute.contaminated([(d["doc_id"], d["text"]) for d in docs], items) if not c[-1]}
    docs = [d for d in docs if d["doc_id"] in clean]
    got = [tuple(r) for r in corpus_pipeline.run(spark, SF).collect()]
    want = schedule(docs)
    # shares are doubles, summed in another order: a deadline may fall on either side of a whole number
    assert sorted((*g[:4], *g[6:]) for g in got) == sorted((*w[:4], *w[6:]) for w in want)
    assert all(abs(x - y) <= 1 for g, w in zip(sorted(got), sorted(want), strict=True) for x, y in zip(g[4:6], w[4:6], strict=True))
    assert 50 < len(got) < 200 and not Counter(g[0] for g in got).most_common(1)[0][1] > 1


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(corpus_pipeline.STAGES) == 5
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), SF).columns == docs.columns, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), SF).count() == 0
