"""Blocks of mails: splitting, scoring, and one row per mail."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillon.functions import scoring as S
from quillon.functions.html import split_blocks
from quillon.functions.numeric import round_exact
from quillon.functions.text import PROMPT_CAP, cap, strip


def blocks(mails: DataFrame, key: str = "file", html: str = "html") -> DataFrame:
    """key, block_idx, type, content, position: one row per block; no shuffle."""
    return mails.select(key, F.posexplode(split_blocks(F.col(html))).alias("block_idx", "b")).select(key, "block_idx", "b.type", "b.content", "b.position")


def score_blocks(replied: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Adds the engine's columns to rows of ai_probability (text) and flags (array).

    llm (0..1), s_<signal>, score (unrounded), ai_score (percent), verdict, confidence, engine_explanation.
    """
    x = replied.withColumn("llm", S.normalize_probability(F.col("ai_probability")))
    x = x.withColumns({f"s_{k}": v for k, v in S.signals(F.col("llm"), S.features(F.col("flags"))).items()})
    s = {k: F.col(f"s_{k}") for k in S.WEIGHTS}
    x = x.withColumn("score", S.score(s, weights))
    return x.withColumns({
        "ai_score": S.block_percent(F.col("score")),
        "verdict": S.verdict(F.col("score")),
        "confidence": S.confidence(s),
        "engine_explanation": S.explanation(F.col("score"), s),
    })


def global_flags(blocks_: Column) -> Column:
    """Distinct flags over blocks in order, raw spelling, by first place."""
    return F.array_distinct(F.flatten(F.transform(blocks_, lambda b: b["flags"])))


def high_risk(blocks_: Column, least: float = 70.0) -> Column:
    return F.filter(blocks_, lambda b: b["ai_score"] >= least)


def ocr_text(results: Column, n: int = PROMPT_CAP) -> Column:
    """Text of all images that have some, each under its source, capped; results: array of (source, text) in order."""
    kept = F.filter(F.transform(results, lambda r: F.struct(F.coalesce(r["source"], F.lit("unknown")).alias("source"), strip(F.coalesce(r["text"], F.lit(""))).alias("text"))), lambda r: r["text"] != "")
    return cap(F.array_join(F.transform(kept, lambda r: F.concat(F.lit("IMAGE: "), r["source"], F.lit("\n"), r["text"])), "\n\n"), n)


def has_ocr_text(results: Column) -> Column:
    return F.exists(results, lambda r: strip(F.coalesce(r["text"], F.lit(""))) != "")


def aggregate_mails(scored: DataFrame, key: str = "file", ocr: DataFrame | None = None) -> DataFrame:
    """One row per mail from score_blocks' rows, in one shuffle; ocr: key, results, ocr_probability (0..1), flags, summary.

    blocks (nested, in order), html_ai_score, ocr_ai_score, global_ai_score, verdict, global_flags, high_risk_blocks,
    engine, images_count. The mean is taken over whole tenths, so that it doesn't depend on the order.
    """
    signals = F.struct(*[S.score3(F.col(f"s_{k}")).alias(k) for k in S.WEIGHTS])
    block = F.struct(
        "block_idx", F.col("type").alias("block_type"), "position", F.col("ai_probability").alias("llm_probability"), "ai_score",
        "verdict", "confidence", "flags", "summary", "engine_explanation", signals.alias("signals"),
    )
    agg = scored.groupBy(key).agg(F.array_sort(F.collect_list(block)).alias("blocks"), (F.sum(F.round(F.col("ai_score") * 10).cast("bigint")) / F.lit(10.0) / F.count(F.lit(1))).alias("mean"))
    if ocr is not None:
        agg = agg.join(ocr.withColumnsRenamed({"flags": "ocr_flags", "summary": "ocr_summary"}), key, "left")
    else:
        agg = agg.withColumns({"results": F.lit(None).cast("array<struct<source:string,text:string,has_text:boolean>>"), "ocr_probability": F.lit(0.0), "ocr_flags": F.lit(None).cast("array<string>"), "ocr_summary": F.lit("")})
    results = F.coalesce("results", F.array())
    has = F.coalesce(has_ocr_text(F.col("results")), F.lit(False))
    agg = agg.withColumns({"has_ocr": has, "ocr_p": F.when(has, F.coalesce("ocr_probability", F.lit(0.0))).otherwise(F.lit(0.0))})
    b = S.blend(F.col("mean") / F.lit(100.0), F.col("ocr_p"), F.col("has_ocr"))
    agg = agg.withColumns({f"e_{k}": v for k, v in b.items()})
    e = {k: F.col(f"e_{k}") for k in b}
    return agg.select(
        key,
        "blocks",
        round_exact(F.col("mean"), 1).alias("html_ai_score"),
        S.percent(F.col("ocr_p")).alias("ocr_ai_score"),
        S.percent(e["final"]).alias("global_ai_score"),
        S.verdict(e["final"], S.MAIL_LIMITS).alias("verdict"),
        global_flags(F.col("blocks")).alias("global_flags"),
        high_risk(F.col("blocks")).alias("high_risk_blocks"),
        F.struct(
            S.score3(e["final"]).alias("final_score"),
            F.struct(S.score3(e["html_score"]).alias("html_score"), S.score3(e["ocr_score"]).alias("ocr_score"), e["html_weight"].alias("html_weight"), e["ocr_weight"].alias("ocr_weight"), F.col("has_ocr")).alias("signals"),
            S.mail_explanation(e).alias("explanation"),
        ).alias("engine"),
        F.struct(F.size(results).alias("images_count"), F.col("results").alias("text"), S.percent(F.col("ocr_p")).alias("ai_score"), F.coalesce("ocr_flags", F.array().cast("array<string>")).alias("flags"), F.coalesce("ocr_summary", F.lit("")).alias("summary")).alias("ocr"),
    )


def legacy_global_score(scored: DataFrame, key: str = "file", score: str = "p") -> DataFrame:
    """Mean of whole block percentages, rounded to a whole number: the report of earlier versions."""
    return scored.groupBy(key).agg(F.bround(F.avg(score), 0).cast("long").alias("global_ai_score"))


def drop_rule(mails: DataFrame, html: str = "html", images: str = "images") -> DataFrame:
    """Without mails of fewer than ten characters of body and no image; such a body is blanked if there is an image."""
    short = F.char_length(strip(F.coalesce(F.col(html), F.lit("")))) < 10
    none = F.coalesce(F.size(images), F.lit(0)) <= 0
    return mails.where(~(short & none)).withColumn(html, F.when(short, F.lit("")).otherwise(F.col(html)))
