"""Exact line deduplication with DataFrame functions only.

Lines are known by a 128-bit hash of their normalised key. Keys that very many documents hold are found first, by
partial aggregates, and their lines are decided where they stand, against a broadcast list of bounded size. All other lines are partitioned by ranges of the hash
and sorted by hash, document and position, so that one stream over a range meets the occurrences of a key
one after the other, tells the document that keeps them from the others, and counts the documents. What comes back per document is a
compressed bitmap of dropped lines (64-line words, absent where nothing is dropped),
never text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.llm.common import BLANKS, ascii_lower, cut, packed, scratch, small_enough, stored


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_key(line: Column) -> Column:
    return ascii_lower(F.trim(line, F.lit(BLANKS)))


def _hashes(key: Column) -> list[Column]:
    return [F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(20011), key).alias("h2")]


#: A key is hot if one document in so many holds it: there are at most so many hot keys for each line that a document has on average.
HOT = 1000


def drop_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per document that loses lines: doc_id, th (hash of its text), drops (map of word to 64 bits).

    A line is dropped if its key (blanks stripped, A-Z lower-cased) has at least min_chars code points,
    occurs in documents of at least min_docs different doc_ids, and the document isn't the one of largest doc_id holding it.
    Rows that share a doc_id are one document for this count; all those of the largest id keep the line.
    A null doc_id is an id that ranks below all others. Null text is one empty line. An empty table gives no rows.
    """
    spark = docs.sparkSession
    # the hash first: beside the lines, it would be taken of the whole text for each of them
    body = docs.select("doc_id", F.xxhash64("text").alias("th"), F.transform(_lines(F.col("text")), line_key).alias("ks"))
    # outer, or a filter on the lines' number goes below and cuts every text up twice
    body = body.select("doc_id", "th", F.posexplode_outer("ks").alias("pos", "k"))
    with scratch(spark) as folder:
        lines = stored(body.where(F.char_length("k") >= min_chars).select("doc_id", "th", "pos", *_hashes(F.col("k"))), folder)
        # distinct first: a hot key's rows are spread by document before they are counted
        held = lines.select("h1", "h2", "doc_id").distinct().groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("last"))
        most = max(min_docs, -(-docs.count() // HOT))
        hot = small_enough(cut(held.where(F.col("n") >= most)))
        there = lines.join(hot.select("h1", "h2", "last"), ["h1", "h2"]).where(F.col("doc_id").isNull() | (F.col("doc_id") < F.col("last")))
        rest = lines.join(hot.select("h1", "h2"), ["h1", "h2"], "left_anti").repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2", F.desc_nulls_last("doc_id"), "pos")
        key = W.partitionBy("h1", "h2")
        # rank 1 keeps its lines; the last document's rank is the number of documents
        rest = rest.withColumn("r", F.dense_rank().over(key.orderBy(F.desc_nulls_last("doc_id")))).withColumn("n", F.max("r").over(key))
        rest = rest.where((F.col("n") >= min_docs) & (F.col("r") > 1))
        hit = there.select("doc_id", "th", "pos").unionByName(rest.select("doc_id", "th", "pos"))
        word = F.expr("pos div 64").cast("int")
        bits = hit.groupBy("doc_id", "th", word.alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos % 64)")).alias("bits"))
        return cut(bits.groupBy("doc_id", "th").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("word", "bits")))).alias("drops")))


def mark_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """q_row (the row of docs), doc_id and q_drops, the compressed bitmap of dropped lines (null: none)."""
    bits = drop_bitmaps(docs, min_chars, min_docs).select(F.col("doc_id").alias("q_id"), F.col("th").alias("q_th"), F.col("drops").alias("q_drops"))
    left = packed(docs).withColumn("q_hash", F.xxhash64("q_row.text"))
    joined = left.join(bits, F.col("doc_id").eqNullSafe(F.col("q_id")) & (F.col("q_hash") == F.col("q_th")), "left")
    return joined.drop("q_id", "q_th", "q_hash")


def _keep(text: Column, drops: Column) -> Column:
    """The text without its dropped lines. The bitmap is made dense first, so that each line is one array access."""
    words = F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys(drops))), lambda w: F.coalesce(F.element_at(drops, w), F.lit(0).cast("long")))
    pair = F.arrays_zip(_lines(text).alias("line"), F.flatten(F.transform(words, lambda b: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(b, i)))).alias("bit"))
    n = F.size(_lines(text))
    return F.array_join(F.transform(F.filter(F.slice(pair, 1, n), lambda p: F.coalesce(p["bit"], F.lit(0)) == 0), lambda p: p["line"]), "\n")


def line_dedup(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """docs with repeated lines taken out of text (n_chars follows, where it exists); all rows and columns stay."""
    out = mark_lines(docs, min_chars, min_docs)
    text = F.when(F.col("q_drops").isNull(), F.col("q_row.text")).otherwise(_keep(F.col("q_row.text"), F.col("q_drops")))
    row = F.col("q_row").withField("text", F.col("q_text"))
    if "n_chars" in docs.columns:
        row = row.withField("n_chars", F.char_length("q_text").cast(docs.schema["n_chars"].dataType))
    return out.select("q_row", text.alias("q_text")).select(row.alias("q_row")).select("q_row.*")


def digest(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256, and dropped, the bitmap of dropped lines: word:bits of each word of 64 lines that loses any, comma-joined.

    A null text is one empty line and drops nothing; repeated rows give repeated rows; an empty table gives none.
    """
    marked = mark_lines(docs.select("doc_id", "text"), min_chars, min_docs)
    text = F.coalesce(F.col("q_row.text"), F.lit(""))
    kept = F.when(F.col("q_drops").isNull(), text).otherwise(_keep(text, F.col("q_drops")))
    unsigned = lambda b: F.when(b >= 0, b.cast("string")).otherwise((b.cast("decimal(20,0)") + F.lit(str(1 << 64)).cast("decimal(20,0)")).cast("decimal(20,0)").cast("string"))
    dropped = F.aggregate(F.coalesce(F.map_values("q_drops"), F.array().cast("array<bigint>")), F.lit(0).cast("long"), lambda a, b: a + F.bit_count(b))
    return marked.select(
        "doc_id",
        (F.char_length(text) - F.char_length(F.translate(text, "\n", "")) + 1).cast("long").alias("n_lines"),
        dropped.alias("n_dropped"),
        F.sha2(kept.cast("binary"), 256).alias("kept_sha256"),
        F.coalesce(F.array_join(F.transform(F.map_entries("q_drops"), lambda e: F.concat_ws(":", e["key"].cast("string"), unsigned(e["value"]))), ","), F.lit("")).alias("dropped"),
    )


ORACLE = r"""
WITH base AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
ex AS (SELECT doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS pos FROM base),
keyed AS (SELECT doc_id, line, pos, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM ex),
rep AS (SELECT k, max(doc_id) AS last FROM keyed WHERE length(k) >= 20 GROUP BY k HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT e.doc_id, e.line, e.pos, (r.k IS NOT NULL AND e.doc_id < r.last) AS gone FROM keyed e LEFT JOIN rep r ON e.k = r.k),
wo AS (SELECT doc_id, (pos - 1) // 64 AS word, sum(1::HUGEINT << ((pos - 1) % 64)) AS bits FROM marked WHERE gone GROUP BY ALL),
bm AS (SELECT doc_id, string_agg(word || ':' || bits::HUGEINT, ',' ORDER BY word) AS dropped FROM wo GROUP BY doc_id)
SELECT m.doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256, coalesce(any_value(bm.dropped), '') AS dropped
FROM marked m LEFT JOIN bm ON bm.doc_id = m.doc_id GROUP BY m.doc_id
"""
