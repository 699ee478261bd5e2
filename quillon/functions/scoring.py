"""Scores, confidence, verdicts and explanations of blocks and mails, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.numeric import let, round_exact
from quillon.functions.text import strip

#: signal: weight; the order is that of the sum
SIGNALS = ("llm_score", "template_variable", "repeating_pattern", "suspicious_comments", "deep_nesting", "duplicated_styles", "empty_cell")
WEIGHTS = dict(zip(SIGNALS, (0.35, 0.20, 0.15, 0.10, 0.05, 0.05, 0.10), strict=True))
FLAG_OF = {
    "template_variable": "TEMPLATE_VARIABLE",
    "repeating_pattern": "REPETITIVE_PATTERN",
    "suspicious_comments": "SUSPICIOUS_COMMENT",
    "deep_nesting": "TOO_DEEP_NESTING",
    "duplicated_styles": "DUPLICATE_STYLES",
    "empty_cell": "EMPTY_CELL",
}
LABELS = ("Сгенерировано ИИ (AI-Generated)", "Смешанный текст (AI-Assisted / Редактировано)", "Написано человеком (Human-Written)")
BLOCK_LIMITS, MAIL_LIMITS = (0.70, 0.40), (0.60, 0.30)
SENTENCES = (
    ("template_variable", "Найдены неразрешенные шаблонные переменные (признак автоматизации)."),
    ("repeating_pattern", "Обнаружены неестественные повторяющиеся текстовые или структурные паттерны."),
    ("suspicious_comments", "В разметке присутствуют подозрительные или автогенерируемые комментарии."),
)
ANOMALIES = (("deep_nesting", "глубокая вложенность"), ("duplicated_styles", "дублирование стилей"), ("empty_cell", "пустые ячейки"))
LIKELY = "Модель выявила высокую базовую вероятность машинного текста."
INDEX = "Индекс AI-генерации: "
ODD = ("Аномалии форматирования (", "), характерные для машинной генерации HTML.")

_NUMBER = r"^\s*[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*$"
_ENDLESS = r"(?i)^\s*([+-]?)(inf|infinity)\s*$"


def to_number(p: Column) -> Column:
    """What a JSON value, as text, is worth as a number; 0 for what isn't one. JSON true is 1, NaN stays NaN."""
    plain = F.try_cast if hasattr(F, "try_cast") else None
    number = F.regexp_replace(F.trim(p), "_", "")
    value = number.try_cast("double") if plain is None else plain(number, "double")
    return (
        F.when(p.rlike(_NUMBER), value)
        .when(p.rlike(_ENDLESS), F.when(p.rlike(r"^\s*-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf"))))
        .when(p.rlike(r'^"?(?i:[+-]?nan)"?$'), F.lit(float("nan")))
        .when(p == "true", F.lit(1.0))
        .otherwise(F.lit(0.0))
    )


def unit(x: Column) -> Column:
    """Percentages above 1 to shares, clamped to 0..1; NaN is 1, since the upper bound is taken first."""
    return let(x, lambda v: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(v > 1, v / F.lit(100.0)).otherwise(v))))


def normalize_probability(p: Column) -> Column:
    """Raw answer (string of a JSON value, or null) to 0..1."""
    return unit(F.coalesce(to_number(p), F.lit(0.0)))


def flag_names(flags: Column) -> Column:
    return F.transform(F.coalesce(flags, F.array().cast("array<string>")), lambda f: F.upper(strip(f)))


def features(flags: Column) -> dict[str, Column]:
    """The six weighted signals as booleans; names of flags count whatever their case and outer white space. Null is none."""
    names = flag_names(flags)
    return {k: F.coalesce(F.array_contains(names, F.lit(v)), F.lit(False)) for k, v in FLAG_OF.items()}


def signals(probability: Column, on: dict[str, Column]) -> dict[str, Column]:
    """The seven signals. The probability is taken as it is: one given in percent isn't scaled here."""
    return {"llm_score": probability, **{k: F.when(on[k], F.lit(1.0)).otherwise(F.lit(0.0)) for k in FLAG_OF}}


def score(s: dict[str, Column], weights: dict[str, float] | None = None) -> Column:
    w = WEIGHTS if weights is None else weights
    return reduce(lambda a, b: a + b, [s[k] * F.lit(float(w[k])) for k in w])


def confidence(s: dict[str, Column]) -> Column:
    """From the spread of the signals, in percent with one digit, as text."""
    values = list(s.values())
    mean = reduce(lambda a, b: a + b, values) / F.lit(7.0)
    var = let(mean, lambda m: reduce(lambda a, b: a + b, [(v - m) * (v - m) for v in values]) / F.lit(7.0))
    share = F.greatest(F.lit(0.50), F.least(F.lit(0.99), F.lit(0.98) - var * F.lit(0.8)))
    return F.concat(F.round(share * F.lit(100.0), 1).cast("string"), F.lit("%"))


def verdict_code(x: Column, limits: tuple[float, float]) -> Column:
    """0 generated, 1 assisted, 2 human; of the score before rounding."""
    return F.when(x >= limits[0], 0).when(x >= limits[1], 1).otherwise(2)


def verdict(x: Column, limits: tuple[float, float] = BLOCK_LIMITS) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in LABELS]), verdict_code(x, limits) + 1)


def explanation(x: Column, s: dict[str, Column]) -> Column:
    odd = F.concat_ws(", ", *[F.when(s[k] > 0, F.lit(v)) for k, v in ANOMALIES])
    sentence = let(odd, lambda o: F.when(o != "", F.concat(F.lit(ODD[0]), o, F.lit(ODD[1]))))
    return F.concat_ws(
        " ",
        F.concat(F.lit(INDEX), percent(x).cast("string"), F.lit("/100.")),
        F.when(s["llm_score"] > 0.7, F.lit(LIKELY)),
        *[F.when(s[k] > 0, F.lit(v)) for k, v in SENTENCES],
        sentence,
    )


def percent(x: Column) -> Column:
    """A share in percent, one digit."""
    return round_exact(x * F.lit(100.0), 1)


def score3(x: Column) -> Column:
    return round_exact(x, 3, 2)


def block_percent(x: Column) -> Column:
    """A block's percentage is rounded twice: to three digits as a share, then to one in percent."""
    return round_exact(score3(x) * F.lit(100.0), 1)


def blend_weights(html: Column, has_ocr: Column) -> tuple[Column, Column]:
    """Weights of body and image text; of a body of little score the text weighs more."""
    w = F.when(~has_ocr, 1.0).when(html < 0.30, 0.30).otherwise(0.50)
    o = F.when(~has_ocr, 0.0).when(html < 0.30, 0.70).otherwise(0.50)
    return w, o


def blend(html: Column, ocr: Column, has_ocr: Column, html_weight: float = 0.5, ocr_weight: float = 0.5) -> dict[str, Column]:
    """The mail's score and its parts. The two weights are accepted for compatibility and have no effect."""
    h, o = unit(F.coalesce(html, F.lit(0.0))), unit(F.coalesce(ocr, F.lit(0.0)))
    wh, wo = blend_weights(h, has_ocr)
    return {"html_score": h, "ocr_score": o, "html_weight": wh, "ocr_weight": wo, "final": F.greatest(F.lit(0.0), F.least(F.lit(1.0), h * wh + o * wo))}


def mail_explanation(b: dict[str, Column]) -> Column:
    whole = lambda c: F.concat(F.round(c * 100, 0).cast("int").cast("string"), F.lit("%"))
    part = lambda c: F.concat(percent(c).cast("string"), F.lit("/100."))
    return F.concat(
        F.lit(INDEX), part(b["final"]), F.lit(" HTML: "), part(b["html_score"]), F.lit(" OCR: "), part(b["ocr_score"]),
        F.lit(" Веса: HTML "), whole(b["html_weight"]), F.lit(", OCR "), whole(b["ocr_weight"]), F.lit("."),
    )


CRITICAL = ("spam", "scam", "phishing")
STRONG = ("suspicious_call_to_action", "suspicious calls to action", "suspicious call to action", "aggressive_advertising", "aggressive advertising")
MEDIUM = ("urgent_language", "urgent language")


def ocr_risk(probability: Column, flags: Column) -> Column:
    """Risk 0..100 of image text: the probability, raised by what the flags say. Opt-in; scores don't use it."""
    names = F.transform(F.coalesce(flags, F.array().cast("array<string>")), lambda f: strip(F.lower(f)))
    has = lambda group: F.arrays_overlap(names, F.array(*[F.lit(g) for g in group]))
    fired = F.when(has(CRITICAL), 90.0).when(has(STRONG), 70.0).when(has(MEDIUM), 55.0).otherwise(0.0)
    base = F.coalesce(probability, F.lit(0.0))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), F.greatest(base, fired)))
