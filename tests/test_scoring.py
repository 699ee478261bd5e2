"""Expressions against a plain model of the scoring rules and against fixed vectors."""

import itertools
import math

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillon.functions import scoring as S
from quillon.functions.numeric import round_exact
from quillon.functions.reply import parse_reply
from quillon.functions.text import cap, strip, truncate_text
from quillon.operators.mails import score_blocks

NAMES = list(S.FLAG_OF)


def plain(p, on, weights=S.WEIGHTS):
    """Left-to-right sums and Python's rounding."""
    x = {"llm_score": p, **{k: 1.0 if k in on else 0.0 for k in NAMES}}
    score = 0.0
    for k, w in weights.items():
        score += x[k] * w
    v = list(x.values())
    mean = 0.0
    for y in v:
        mean += y
    mean /= 7
    var = 0.0
    for y in v:
        var += (y - mean) * (y - mean)
    conf = round(max(0.5, min(0.99, 0.98 - var / 7 * 0.8)) * 100, 1)
    verdict = S.LABELS[0 if score >= 0.7 else 1 if score >= 0.4 else 2]
    return score, round(score, 3), round(round(score, 3) * 100, 1), f"{conf}%", verdict


@pytest.fixture(scope="module")
def grid(spark):
    rows = []
    for p in range(101):
        for n in range(7):
            for on in itertools.combinations(NAMES, n):
                rows.append((p, [S.FLAG_OF[k] for k in on]))
    df = spark.createDataFrame(rows, "p int, flags array<string>").withColumn("ai_probability", F.col("p").cast("string"))
    return score_blocks(df).select("p", "flags", "score", S.score3(F.col("score")).alias("s3"), "ai_score", "confidence", "verdict", "engine_explanation").collect()


def test_grid_of_scores(grid):
    assert len(grid) == 6464
    back = {v: k for k, v in S.FLAG_OF.items()}
    for r in grid:
        p = r.p / 100 if r.p > 1 else float(r.p)
        assert (r.score, r.s3, r.ai_score, r.confidence, r.verdict) == plain(p, {back[f] for f in r.flags}), (r.p, r.flags)
        assert 0 <= r.score <= 1 + 1e-12 and 78.4 <= float(r.confidence[:-1]) <= 98.0


def test_every_flag_raises_the_score(grid):
    by = {(r.p, tuple(r.flags)): r.score for r in grid}
    order = [S.FLAG_OF[k] for k in NAMES]
    for (p, flags), score in by.items():
        for f in set(order) - set(flags):
            assert by[p, tuple(sorted((*flags, f), key=order.index))] > score


@pytest.mark.parametrize(
    "p, flags, score, ai, verdict, conf",
    [
        (25, "E", 0.1875, 18.8, 2, "88.4%"),
        (75, "NESCR", 0.7125, 71.3, 0, "88.4%"),
        (15, "", 0.0525, 5.2, 2, "97.8%"),
        (85, "NESCR", 0.7475, 74.8, 0, "88.5%"),
        (45, "EC", 0.35750000000000004, 35.8, 2, "82.6%"),
        (72, "R", 0.402, 40.2, 1, "85.5%"),
        (15, "E", 0.1525, 15.2, 2, "88.5%"),
        (45, "", 0.1575, 15.8, 2, "96.0%"),
        (0, "TRN", 0.39999999999999997, 40.0, 2, None),
        (100, "N", 0.39999999999999997, 40.0, 2, None),
    ],
)
def test_vectors(grid, p, flags, score, ai, verdict, conf):
    names = {"N": "TOO_DEEP_NESTING", "E": "EMPTY_CELL", "S": "DUPLICATE_STYLES", "C": "SUSPICIOUS_COMMENT", "R": "REPETITIVE_PATTERN", "T": "TEMPLATE_VARIABLE"}
    r = next(r for r in grid if r.p == p and set(r.flags) == {names[f] for f in flags})
    assert math.isclose(r.score, score, rel_tol=1e-15) and r.ai_score == ai and r.verdict == S.LABELS[verdict]
    assert conf is None or r.confidence == conf


def test_explanation(grid):
    r = next(r for r in grid if r.p == 85 and set(r.flags) == {"TOO_DEEP_NESTING", "EMPTY_CELL"})
    assert r.engine_explanation == f"Индекс AI-генерации: {round(r.score * 100, 1)}/100. " + S.LIKELY + " Аномалии форматирования (глубокая вложенность, пустые ячейки), характерные для машинной генерации HTML."


@pytest.mark.parametrize(
    "raw, want",
    [
        ("0", 0.0), ("0.5", 0.5), ("1", 1.0), ("1.0001", 1.0001 / 100), ("2", 0.02), ("85", 0.85), (" 85 ", 0.85), ("85%", 0.0), ("null", 0.0), (None, 0.0),
        ("[1]", 0.0), ("true", 1.0), ("false", 0.0), ("-5", 0.0), ("101", 1.0), ("1000", 1.0), ("Infinity", 1.0), ("-inf", 0.0), ("NaN", 1.0), ("5d", 0.0), ("1_0", 0.1), ("1e2", 1.0),
    ],
)
def test_probability(spark, raw, want):
    df = spark.createDataFrame([(raw,)], "x string")
    assert df.select(S.normalize_probability(F.col("x"))).first()[0] == pytest.approx(want, abs=1e-15)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.floats(0.0078125, 1), min_size=1, max_size=60))
def test_round_is_pythons(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    assert [r[0] for r in df.select(round_exact(F.col("x"), 3, 2)).collect()] == [round(x, 3) for x in xs]
    assert [r[0] for r in df.select(round_exact(F.col("x") * 100, 1)).collect()] == [round(x * 100, 1) for x in xs]


def test_blend(spark):
    rows = [(0.5, 0.9, True), (0.29, 0.9, True), (0.9, 0.9, False), (0.3, 0.0, True), (85.0, 40.0, True), (None, None, True), (-1.0, 2.0, True)]
    df = spark.createDataFrame(rows, "h double, o double, has boolean")
    b = S.blend(F.col("h"), F.col("o"), F.col("has"))
    got = [tuple(r) for r in df.select(b["final"], b["html_weight"], b["ocr_weight"], S.verdict_code(b["final"], S.MAIL_LIMITS)).collect()]
    assert got == [(0.7, 0.5, 0.5, 0), (0.29 * 0.3 + 0.9 * 0.7, 0.3, 0.7, 0), (0.9, 1.0, 0.0, 0), (0.15, 0.5, 0.5, 2), (0.85 * 0.5 + 0.4 * 0.5, 0.5, 0.5, 0), (0.0, 0.3, 0.7, 2), (0.02 * 0.7, 0.3, 0.7, 2)]
    x = S.mail_explanation(S.blend(F.lit(0.25), F.lit(0.5), F.lit(True)))
    assert df.select(x).first()[0] == "Индекс AI-генерации: 42.5/100. HTML: 25.0/100. OCR: 50.0/100. Веса: HTML 30%, OCR 70%."


def test_flags_count_whatever_their_case(spark):
    df = spark.createDataFrame([([" empty_cell\n", "Other", "too_deep_nesting "],), (None,)], "f array<string>")
    got = [tuple(r) for r in df.select(*S.features(F.col("f")).values()).collect()]
    assert got == [(False, False, False, True, False, True), (False,) * 6]


def test_raw_percent_in_the_vector(spark):
    s = S.signals(F.lit(85.0), {k: F.lit(False) for k in S.FLAG_OF})
    assert spark.range(1).select(S.score(s)).first()[0] == pytest.approx(29.75)


def test_ocr_risk(spark):
    rows = [(10.0, ["Scam "]), (95.0, ["spam"]), (0.0, ["suspicious calls to action"]), (60.0, ["urgent language"]), (0.0, ["urgent_language"]), (150.0, []), (None, None)]
    df = spark.createDataFrame(rows, "p double, f array<string>")
    assert [r[0] for r in df.select(S.ocr_risk(F.col("p"), F.col("f"))).collect()] == [90.0, 95.0, 70.0, 60.0, 55.0, 100.0, 0.0]


@pytest.mark.parametrize(
    "content, want",
    [
        ('Here: {"ai_probability": 85, "flags": ["A", "b"], "summary": "s"} end', ("85", ["A", "b"], "s")),
        ('{"ai_probability": "85"}', ("85", [], "")),
        ('{"flags": null, "summary": null}', ("0", [], "")),
        ('{"ai_probability": 85', ("0", [], "")),
        ('{"a": 1} and {"ai_probability": 3}', ("0", [], "")),
        ('{"ai_probability": 1, "flags": "AB"}', ("1", ["A", "B"], "")),
        ("no json", ("0", [], "")),
        (None, ("0", [], "")),
        ('line\n{"ai_probability": true,\n "summary": "x"}\n', ("true", [], "x")),
    ],
)
def test_reply(spark, content, want):
    r = spark.createDataFrame([(content,)], "c string").select(parse_reply(F.col("c")).alias("r")).first().r
    assert (r.ai_probability, list(r.flags), r.summary) == want


def test_text_helpers(spark):
    df = spark.createDataFrame([("a" * 501,), ("😀" * 10,), (None,), ("  x \n",)], "t string")
    assert [r[0] for r in df.select(truncate_text(F.col("t"))).collect()] == ["a" * 500 + "...", "😀" * 10, "", "  x \n"]
    assert [r[0] for r in df.select(cap(F.col("t"), 4)).collect()] == ["aaaa...", "😀" * 4 + "...", None, "  x ..."]
    assert df.select(strip(F.col("t"))).collect()[3][0] == "x"
