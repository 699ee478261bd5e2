"""Texts of megabytes: one long line, many lines, one long word."""

import random

import brute
import pytest

from quillon.llm import decontamination, licenses, linededup, neardedup, suffixdedup, toxicity

R = random.Random(6)
WORDS = [f"w{R.randrange(900)}" for _ in range(300_000)]
TEXTS = [
    (1, " ".join(WORDS)),
    (2, " ".join(WORDS[:150_000]) + " released under the mit license " + " ".join(WORDS[150_000:])),
    (3, "\n".join(f"line number {i % 30_000} of the long text" for i in range(60_000))),
    (4, "\n".join(f"line number {i} of the long text" for i in range(20_000))),
    (5, "line number 7 of the long text\nshort"),
    (6, "x" * 1_500_000),
    (7, None),
]


@pytest.fixture(scope="module")
def long(spark):
    return spark.createDataFrame(TEXTS, "doc_id bigint, text string").repartition(3)


def test_lines(long):
    want = brute.lines_kept(TEXTS)
    got = {r.doc_id: r for r in linededup.digest(long).collect()}
    for i, (d, _) in enumerate(TEXTS):
        lines, kept = want[i]
        assert (got[d].n_lines, got[d].n_dropped, got[d].kept_sha256) == (len(lines), len(lines) - len(kept), brute.sha("\n".join(kept)))


def test_near_duplicates(long):
    assert brute.rows(neardedup.near_duplicates(long)) == sorted(brute.near_duplicates(TEXTS), key=str)


def test_licenses(long):
    got = {r.doc_id: r for r in licenses.digest(long).collect()}
    for d, t in TEXTS:
        n, places = brute.phrases(t, licenses.PHRASES)
        assert (got[d].n_words, got[d].n_base) == (n, len(places))
    assert got[2].labels == "mit,mit-reference" and not got[1].labels


def test_decontamination(spark, long):
    items = [(1, " ".join(WORDS[149_990:150_005])), (2, " ".join(WORDS[299_985:])), (3, "x")]
    df = spark.createDataFrame(items, "item_id bigint, text string")
    assert brute.rows(decontamination.digest(long, df)) == sorted(brute.contaminated(TEXTS, items), key=str)


def test_suffixes(long):
    got = {r.doc_id: r for r in suffixdedup.digest(long).collect()}
    assert [got[d].n_bytes for d, _ in TEXTS] == [len((t or "").encode()) for _, t in TEXTS]
    assert got[6].n_removed == 1_500_000 - 1 and got[6].n_spans == 1
    # all that the second has of the first; the blank in the middle is there twice
    assert got[1].n_removed == 0 and got[2].n_removed == got[1].n_bytes + 1 and got[2].n_spans == 2


def test_toxicity(spark, long):
    labels = spark.createDataFrame([(1, 0), (3, 1), (4, 1)], "doc_id bigint, toxic int")
    assert all(0 <= r.score <= 1 for r in toxicity.digest(long, labels).collect())
