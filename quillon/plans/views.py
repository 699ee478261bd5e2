"""Derived views over the public tables, which hold no mails: a mail, an answer and an image per document.

Each view is built by the same expressions in Spark and in the oracle's SQL, over whole tables and whole texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.html import detect_flags, flag_rules
from quillon.operators.mails import blocks, score_blocks

ROW = '<tr><td style="a:1;b:2;c:3;d:4"><img src="x"></td></tr>'
FORMS = (
    '\'<table border="1"><tr><td>\' || s || \'</td></tr></table>\'',
    "repeat('<table><tr><td>', 7) || s || repeat('</td></tr></table>', 7)",
    "'<DIV class=\"content x\">' || s || '</DIV><div id=\"z\" class=\" content\">no</div>'",
    "'<ol><li>' || s || '</li></ol><table><tr><td><ul><li>in</li></ul></td></tr></table>'",
    "'<table>' || repeat('<tr><td>Dear {{name}}</td></tr>', 3) || '</table><p>' || s || '</p>'",
    "'<table><!-- generated 7 --><tr><td>&nbsp;</td><td>' || s || '</td></tr></table><div class=' || chr(39) || 'main' || chr(39) || '><div><div>x</div></div></div>'",
    f"'<table>' || repeat('{ROW}', 3) || '<tr><td><a href=\"http://x.example/?a=1&url=y\">' || s || '</a></td></tr></table>'",
    "s",
)
MAIL = "CASE doc_id % 8 " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(FORMS)) + " END"
P = "(doc_id * 37 + block_idx * 11) % 101"
OCR_P = "(doc_id * 13) % 101"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df over all cores where its files make fewer tasks than there are, as files of one row group do; else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def v_mail(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every block costs some twenty patterns
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", F.expr("coalesce(text, '')").alias("s")))
    return docs.select("doc_id", F.expr(MAIL).alias("html"))


def v_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return blocks(v_mail(spark, sf_dir), "doc_id")


def v_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_blocks(spark, sf_dir).select("doc_id", "block_idx", *[c.alias(n.lower()) for n, c in flag_rules(F.col("content")).items()])


def v_replied(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = v_blocks(spark, sf_dir)
    return b.select("doc_id", "block_idx", "type", "position", F.expr(P).cast("string").alias("ai_probability"), detect_flags(F.col("content")).alias("flags"), F.lit("").alias("summary"))


def v_scored(spark: SparkSession, sf_dir: str, weights: dict[str, float] | None = None) -> DataFrame:
    return score_blocks(v_replied(spark, sf_dir), weights)


def v_ocr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, results, ocr_probability: one image per document, with a benchmark text on every third that isn't a ninth."""
    items = table(spark, sf_dir, "benchmark")
    n = items.count()
    d = table(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % n).alias("item"))
    t = d.join(items.select(F.col("item_id").alias("item"), F.col("text").alias("b")), "item", "left")
    text = F.expr("CASE WHEN doc_id % 3 = 0 AND doc_id % 9 <> 0 THEN coalesce(b, '') ELSE '  ' END")
    one = F.struct(F.concat(F.lit("img_"), F.col("doc_id").cast("string")).alias("source"), text.alias("text"), (text != "").alias("has_text"))
    p = F.expr(OCR_P)
    return t.select("doc_id", F.array(one).alias("results"), F.when(p > 1, p / F.lit(100.0)).otherwise(p.cast("double")).alias("ocr_probability"), F.array().cast("array<string>").alias("flags"), F.lit("").alias("summary"))
