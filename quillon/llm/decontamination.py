"""Benchmark decontamination over a positional inverted index, with DataFrame functions only.

A benchmark item is cut into windows of consecutive words. The corpus is indexed word by
word: a first pass counts how often each benchmark word occurs, and each window then asks
for its rarest words only. Their postings (word, document, position) are partitioned by
document, every list is shifted by the word's offset in the window, and the shifted
lists are intersected by window, document and start. For loose matches the unshifted
lists are intersected by window, document and overlapping stretches of it. What is left
is confirmed word by word on the documents in question, which then report their covered words; no other
document's text is ever moved.

The benchmark doesn't grow with the corpus; its words are broadcast after a check of their
number and joined by shuffle beyond that. Postings are spread by document, so that a word
that every document holds is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.llm.common import cut, packed, small_enough, words


def windows(benchmark: DataFrame, size: int = 10) -> DataFrame:
    """item_id, win (number of the window in its item), terms; a shorter item with words is one window; repeats stay."""
    items = benchmark.select("item_id", words(F.col("text")).alias("ws")).where(F.size("ws") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - size, F.lit(0)))
    return items.select("item_id", "ws", F.explode(starts).alias("win")).select("item_id", "win", F.slice("ws", F.col("win") + 1, F.lit(size)).alias("terms"))


def tokens(docs: DataFrame) -> DataFrame:
    """th, doc_id, pos, term: the corpus word by word."""
    # the hash first: beside the words, it would be taken of the whole text for each of them
    cut_up = docs.select("doc_id", F.xxhash64("text").alias("th"), words(F.col("text")).alias("ws"))
    # outer, or a filter on the words' number goes below and cuts every text up twice
    return cut_up.select("doc_id", "th", F.posexplode_outer("ws").alias("pos", "term")).where("pos is not null")


def rarest(docs: DataFrame, wins: DataFrame, lists: int = 2) -> DataFrame:
    """wid, term, offset, need, r (from 1): for each window the words (and first offset each) that occur least in docs."""
    vocabulary = wins.select(F.explode("terms").alias("term")).distinct()
    df = tokens(docs).join(small_enough(vocabulary), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    at = wins.select("wid", F.posexplode("terms").alias("offset", "term")).groupBy("wid", "term").agg(F.min("offset").alias("offset"))
    # A word that docs never hold rules its window out; the inner join of the lists sees to that.
    ranked = at.join(df, "term", "left").withColumn("r", F.row_number().over(W.partitionBy("wid").orderBy(F.coalesce("df", F.lit(0)), "term")))
    chosen = ranked.where(F.col("r") <= lists)
    alive = chosen.groupBy("wid").agg(F.count(F.lit(1)).alias("need"), F.min(F.coalesce("df", F.lit(0))).alias("least")).where("least > 0")
    return chosen.join(alive, "wid").select("wid", "term", "offset", "need", "r")


def _index(docs: DataFrame, benchmark: DataFrame, size: int, lists: int = 2) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Windows (item_id, win, terms, wid), the rarest words of each (see rarest), and the postings of these words (term, doc_id, th, pos)."""
    wins = cut(windows(benchmark, size).select("item_id", "win", "terms", F.xxhash64("terms").alias("wid")))
    anchors = cut(rarest(docs, wins.select("wid", "terms").distinct(), lists))
    postings = tokens(docs).join(small_enough(anchors.select("term").distinct()), "term")
    # by document: what follows intersects lists within documents, without another shuffle, and reads this one's files twice
    return wins, anchors, postings.select("term", "doc_id", "th", "pos").repartition("doc_id", "th")


def _exact(wins: DataFrame, anchors: DataFrame, postings: DataFrame) -> DataFrame:
    """doc_id, th, item_id, start, terms: candidates whose rarest words stand as in the window."""
    shifted = postings.join(small_enough(anchors), "term").select("wid", "doc_id", "th", (F.col("pos") - F.col("offset")).alias("start"), "need")
    both = shifted.groupBy("wid", "doc_id", "th", "start").agg(F.count(F.lit(1)).alias("n"), F.max("need").alias("need"))
    # the same document twice gives the same posting twice, hence >=
    met = both.where(F.col("n") >= F.col("need")).select("wid", "doc_id", "th", "start").distinct()
    return met.join(small_enough(wins), "wid").select("doc_id", "th", "item_id", "win", "start", "terms")


def _near(wins: DataFrame, anchors: DataFrame, postings: DataFrame, slop: int) -> DataFrame:
    """doc_id, th, item_id, win, start, terms, span: candidates that hold the rarest words of a window between start and start + 2 * span.

    span is the number of words of the window and twice the slop. Bins are two spans long and start at every span, so
    each stretch of span words lies in one of them as a whole, wherever in it the words stand.
    """
    spans = wins.select("wid", (F.size("terms") + 2 * slop).alias("span")).distinct()
    placed = postings.join(small_enough(anchors.join(spans, "wid").select("wid", "term", "need", "span", F.expr("shiftleft(1, r - 1)").alias("bit"))), "term")
    binned = placed.withColumn("bin", F.explode(F.expr("array(pos div span, pos div span - 1)"))).where("bin >= 0")
    both = binned.groupBy("wid", "doc_id", "th", "bin").agg(F.bit_count(F.bit_or("bit")).alias("n"), F.max("need").alias("need"), F.max("span").alias("span"))
    met = both.where(F.col("n") >= F.col("need"))
    return met.join(small_enough(wins), "wid").select("doc_id", "th", "item_id", "win", (F.col("bin") * F.col("span")).cast("int").alias("start"), "terms", "span")


#: Starts of the stretches of c.span words, from c.start on, that hold all words of the candidate c; w: the words of the text.
_NEAR_STARTS = """if(size(array_except(c.terms, slice(w, c.start + 1, 2 * c.span))) > 0, array(),
    filter(sequence(c.start, c.start + c.span - 1), p -> size(array_except(c.terms, slice(w, p + 1, c.span))) = 0))"""


#: Documents in question whose ids are broadcast, at most; 64 bits each.
CANDIDATES = 1_000_000


def _texts(docs: DataFrame, found: DataFrame) -> DataFrame:
    """q_id, q_th and q_words of the documents that found (q_id, q_th) names, each once."""
    keys = small_enough(found.select(F.xxhash64("q_id", "q_th").alias("q_key")).distinct(), CANDIDATES)
    here = docs.select(F.col("doc_id").alias("d_id"), F.xxhash64("text").alias("d_th"), F.col("text").alias("d_text"))
    texts = here.join(keys, F.xxhash64("d_id", "d_th") == F.col("q_key"), "left_semi").dropDuplicates(["d_id", "d_th"])
    return found.join(texts, F.col("q_id").eqNullSafe(F.col("d_id")) & (F.col("q_th") == F.col("d_th"))).select(*found.columns, words(F.col("d_text")).alias("q_words"))


def _confirmed(docs: DataFrame, benchmark: DataFrame, size: int, slop: int | None = None) -> DataFrame:
    """q_id, q_th and the confirmed candidates of the documents that have any: q_ok, exact ones, and q_near, those within slop, where it is given."""
    index = _index(docs, benchmark, size)
    found = _exact(*index).withColumn("span", F.lit(None).cast("int"))
    if slop is not None:
        found = found.unionByName(_near(*index, slop))
    found = found.groupBy("doc_id", "th").agg(F.collect_set(F.struct("item_id", "start", "terms", "span")).alias("q_found"))
    there = _texts(docs, cut(found.select(F.col("doc_id").alias("q_id"), F.col("th").alias("q_th"), "q_found")))
    ok = "filter(q_found, c -> c.span is null and c.start >= 0 and slice(w, c.start + 1, size(c.terms)) = c.terms) AS q_ok"
    near = "" if slop is None else f", filter(q_found, c -> c.span is not null and size({_NEAR_STARTS}) > 0) AS q_near"
    # an array of one, so that a text is cut into words once, not once for each candidate
    return there.select("q_id", "q_th", F.expr(f"transform(array(q_words), w -> struct({ok}{near}))[0]").alias("q")).select("q_id", "q_th", "q.*")


def decontaminate(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """docs without the documents that hold a window of the benchmark; columns as in docs. Null text has no words and stays."""
    hit = small_enough(cut(_confirmed(docs, benchmark, size).where(F.size("q_ok") > 0).select("q_id", "q_th")))
    here = packed(docs).withColumn("q_hash", F.xxhash64("q_row.text"))
    return here.join(hit, F.col("doc_id").eqNullSafe(F.col("q_id")) & (F.col("q_hash") == F.col("q_th")), "left_anti").select("q_row.*")


def proximity(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 5) -> DataFrame:
    """doc_id, item_id, win, start: places where all words of a window stand within its length + 2 * slop words, in any order.

    Repeated words of a window count once. start is the first of each run of such places in a bin of two such lengths.
    Null and empty texts, windows and tables give no rows; repeated rows give theirs once; a null doc_id is an id.
    """
    found = _near(*_index(docs, benchmark, size), slop).groupBy(F.col("doc_id").alias("q_id"), F.col("th").alias("q_th"))
    j = _texts(docs, cut(found.agg(F.collect_set(F.struct("item_id", "win", "start", "terms", "span")).alias("q_found"))))
    places = F.expr(f"transform(array(q_words), w -> transform(q_found, c -> struct(c.item_id AS item_id, c.win AS win, array_min({_NEAR_STARTS}) AS start)))[0]")
    return j.select(F.col("q_id").alias("doc_id"), F.explode(places).alias("p")).select("doc_id", "p.*").where("start is not null").distinct()


def _marked(docs: DataFrame, benchmark: DataFrame, size: int, slop: int | None = None) -> DataFrame:
    """doc_id and n_words of every row, and what _confirmed has of it."""
    there = _confirmed(docs, benchmark, size, slop)
    here = docs.select("doc_id", F.xxhash64("text").alias("th"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    return here.join(there, F.col("doc_id").eqNullSafe(F.col("q_id")) & (F.col("th") == F.col("q_th")), "left")


def _digest() -> list[Column]:
    covered = F.expr("array_distinct(flatten(transform(q_ok, c -> sequence(c.start, c.start + size(c.terms) - 1))))")
    items = F.expr("array_sort(array_distinct(transform(q_ok, c -> cast(c.item_id as string))))")
    n_hit = F.when(F.col("q_ok").isNull(), F.lit(0)).otherwise(F.size(covered)).cast("long")
    return [
        F.col("doc_id"),
        F.col("n_words"),
        n_hit.alias("n_hit"),
        F.when(F.col("q_ok").isNull(), F.lit(0)).otherwise(F.size(items)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join(items, ","), F.lit("")).cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    ]


def digest(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every document; a null text has no words.

    Repeated rows of docs give repeated rows; an empty benchmark hits nothing; items of fewer words than a window are one window.
    """
    marked = _marked(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), size)
    return marked.select(*_digest())


def report(docs: DataFrame, benchmark: DataFrame, size: int = 10, slop: int = 5) -> DataFrame:
    """digest's columns, and n_near and near_items (comma-separated): the items of which all words of a window stand together as in proximity()."""
    marked = _marked(docs.select("doc_id", "text"), benchmark.select("item_id", "text"), size, slop)
    items = F.coalesce(F.expr("array_sort(array_distinct(transform(q_near, c -> cast(c.item_id as string))))"), F.array().cast("array<string>"))
    return marked.select(*_digest(), F.size(items).cast("long").alias("n_near"), F.array_join(items, ",").alias("near_items"))


ORACLE = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, least(10, len(ws)) AS n, array_to_string(ws[i:i + least(10, len(ws)) - 1], ' ') AS p
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 8, 2))) AS i FROM bw WHERE len(ws) > 0)),
ns AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, n, ws, unnest(range(1, len(ws) - n + 2)) AS i FROM dw, ns WHERE len(ws) >= n),
sh AS (SELECT doc_id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS p FROM places),
hit AS (SELECT sh.doc_id, sh.i, sh.n, win.item_id FROM sh JOIN win ON sh.p = win.p AND sh.n = win.n),
cov AS (SELECT doc_id, count(DISTINCT i + o) AS n_hit FROM (SELECT doc_id, i, unnest(range(0, n)) AS o FROM hit) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hit) GROUP BY doc_id),
ww AS (SELECT item_id, p, n + 10 AS span, list_distinct(string_split(p, ' ')) AS l FROM win),
wd AS (SELECT item_id, p, span, len(l) AS m, unnest(l) AS w FROM ww),
tk AS (SELECT doc_id, unnest(ws) AS w, unnest(range(1, len(ws) + 1)) AS pos FROM dw),
tw AS (SELECT * FROM tk WHERE w IN (SELECT w FROM wd)),
pr AS (SELECT doc_id, item_id, p FROM (SELECT DISTINCT doc_id, w FROM tw) x JOIN wd USING (w) GROUP BY doc_id, item_id, p, m HAVING count(*) = m),
po AS (SELECT pr.doc_id, pr.item_id, pr.p, wd.m, wd.span, wd.w, tw.pos FROM pr JOIN wd ON wd.item_id = pr.item_id AND wd.p = pr.p JOIN tw ON tw.doc_id = pr.doc_id AND tw.w = wd.w),
nr AS (SELECT a.doc_id, a.item_id FROM po a JOIN po b ON b.doc_id = a.doc_id AND b.item_id = a.item_id AND b.p = a.p AND b.pos BETWEEN a.pos AND a.pos + a.span - 1
  GROUP BY a.doc_id, a.item_id, a.p, a.pos, a.m HAVING count(DISTINCT b.w) = a.m),
ni AS (SELECT doc_id, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS near_items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM nr) GROUP BY doc_id)
SELECT dw.doc_id, len(ws) AS n_words, coalesce(cov.n_hit, 0) AS n_hit, coalesce(it.n_items, 0) AS n_items,
  sha256(coalesce(it.items, '')) AS items_sha256, coalesce(cov.n_hit, 0) > 0 AS contaminated, coalesce(ni.n_near, 0) AS n_near, coalesce(ni.near_items, '') AS near_items
FROM dw LEFT JOIN cov ON dw.doc_id = cov.doc_id LEFT JOIN it ON dw.doc_id = it.doc_id LEFT JOIN ni ON dw.doc_id = ni.doc_id
"""
