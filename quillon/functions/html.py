"""HTML bodies into blocks, and rule-based artefact flags of a block."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillon.functions.text import BODY_CAP, cap

AREAS = ("content", "footer", "header", "main", "section")


def element(tag: str, attributes: str = "") -> str:
    """Pattern of an element up to its first closing tag."""
    return f"<{tag}[^>]*{attributes}>.*?</{tag}>"


def area(quote: str) -> str:
    """Pattern of an opening tag's rest whose class begins with the name of an area; quote: a class of quotes."""
    return f"class=[{quote}](?:{'|'.join(AREAS)})[^{quote}]*[{quote}][^>]*"


TABLE = f"(?is)({element('table')})"
SECTION = f"(?is)({element('div', area(chr(34) + chr(39)))})"
LISTS = f"(?is)({element('ul')}|{element('ol')})"
KINDS = (("table", "table", TABLE), ("div_section", "section", SECTION), ("list", "list", LISTS))

#: the six flags that carry weight come first
FLAGS = (
    "TEMPLATE_VARIABLE",
    "REPETITIVE_PATTERN",
    "SUSPICIOUS_COMMENT",
    "TOO_DEEP_NESTING",
    "DUPLICATE_STYLES",
    "EMPTY_CELL",
    "INLINE_STYLE_OVERUSE",
    "SUSPICIOUS_LINK",
    "MISSING_ALT",
    "STRUCTURAL_REDUNDANCY",
)


def body_cap(html: Column) -> Column:
    return cap(F.coalesce(html, F.lit("")), BODY_CAP)


def _all(c: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def split_blocks(html: Column) -> Column:
    """Array of (type, content, position): tables, sections and lists of the capped body, each kind by place.

    The kinds are looked for independently, so a list inside a table comes twice. Without any, the whole body is one
    text block. A null body is empty.
    """
    h = body_cap(html)

    def kind(name: str, label: str, pattern: str) -> Column:
        return F.transform(_all(h, pattern), lambda x, i: F.struct(F.lit(name).alias("type"), x.alias("content"), F.concat(F.lit(f"{label}_"), i.cast("string")).alias("position")))

    found = F.concat(*[kind(*k) for k in KINDS])
    whole = F.array(F.struct(F.lit("text_block").alias("type"), h.alias("content"), F.lit("full_text").alias("position")))
    return F.when(F.size(found) == 0, whole).otherwise(found)


def _depth(h: Column) -> Column:
    tags = _all(F.lower(h), "(</?table)")
    step = F.aggregate(
        tags,
        F.struct(F.lit(0).alias("d"), F.lit(0).alias("m")),
        lambda a, t: F.struct(
            (a["d"] + F.when(t == "<table", 1).otherwise(-1)).alias("d"),
            F.greatest(a["m"], a["d"] + F.when(t == "<table", 1).otherwise(-1)).alias("m"),
        ),
        lambda a: a["m"],
    )
    return step


def _styles(h: Column) -> Column:
    return _all(h, r'(?is)style="([^"]*)"')


def flag_rules(h: Column) -> dict[str, Column]:
    """Boolean column by flag. The rules are this library's reading of the flags' definitions."""
    rows = _all(h, r"(?is)(<(?:tr|li)[^>]*>.*?</(?:tr|li)>)")
    styles = _styles(h)
    return {
        "TEMPLATE_VARIABLE": h.rlike(r"\{\{\s*\w+\s*\}\}"),
        "REPETITIVE_PATTERN": F.size(rows) - F.size(F.array_distinct(rows)) >= 2,
        "SUSPICIOUS_COMMENT": h.rlike(r"(?is)<!--[^>]*(generated|template)"),
        "TOO_DEEP_NESTING": _depth(h) > 5,
        "DUPLICATE_STYLES": F.size(styles) - F.size(F.array_distinct(styles)) >= 2,
        "EMPTY_CELL": h.rlike(r"(?is)<td[^>]*>(\s|&nbsp;)*</td>"),
        "INLINE_STYLE_OVERUSE": F.exists(styles, lambda s: F.size(F.filter(F.split(s, ";"), lambda x: F.trim(x) != "")) > 3),
        "SUSPICIOUS_LINK": h.rlike(r"(?is)href=[\"'][^\"']*[?&](url|redirect)="),
        "MISSING_ALT": F.exists(_all(h, r"(?is)(<img[^>]*>)"), lambda i: ~F.contains(F.lower(i), F.lit("alt="))),
        "STRUCTURAL_REDUNDANCY": h.rlike(r"(?is)<div[^>]*>\s*<div[^>]*>\s*<div"),
    }


def detect_flags(h: Column) -> Column:
    """Array of the names of the flags whose rules fire."""
    return F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in flag_rules(h).items()]), lambda x: x.isNotNull())
