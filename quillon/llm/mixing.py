"""Mixing of sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source owns a share of the schedule. Its documents, in a pseudo-random but fixed
order, are cut into blocks of equal size; block k of a source of weight w may start at
slot floor(k/w) and must be placed before slot ceil((k+1)/w). Earliest deadline first
among the released blocks keeps every source less than one block away from its weight
after each slot. Weights are ratios of whole numbers, and all comparisons are made in
whole numbers. As many slots are laid out as it takes to place every block, or one
period of the weights where that is shorter: a single SQL expression lays out one cycle
after the other and carries the blocks placed so far from each to the next. That is the work of one task,
so blocks grow with the table beyond BLOCKS of them: the layout has a bounded size, and the deviation stays less than a block.

Ranks are taken without sorting a source in one task: documents are counted by source and
range of the order's hash, running totals over those counts give each range its offset,
and only the documents of one range are sorted together.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.llm.common import cut, small_enough

#: Documents that share a hash range, about.
RANGE_ROWS = 4096
#: Documents of a block at least, and blocks of all sources at most, about.
BLOCK, BLOCKS = 8, 100_000


#: Products of slots and weights stay below this, hence within a bigint.
MOST = 4e18


def plan(sources: DataFrame, cycle: int = 1000) -> DataFrame:
    """sources (source, target: relative weight; blocks, if there) to one row per slot laid out: source, q, weight, total, cycle, slot, i.

    Without blocks, one cycle is laid out; else, cycle by cycle, as many slots as place all blocks of all sources,
    or one period of the weights if that is less. cycle is the number of slots laid out, q those of the source among
    them, i its i-th. weight / total is the source's share in whole numbers: the targets themselves if they are whole,
    else rounded to 10^-15 or as finely as the number of slots lets a bigint hold.
    """
    w = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    blocks = F.col("blocks") if "blocks" in sources.columns else F.lit(None)
    share = sources.where(F.col("target") > 0).select("source", "target", blocks.cast("double").alias("b"), F.sum("target").over(w).alias("sum"))
    share = share.withColumn("most", F.greatest(F.max(F.col("b") * F.col("sum") / F.col("target")).over(w), F.lit(float(cycle))) + 2)
    whole = F.min(F.col("target") == F.floor("target")).over(w) & (F.col("sum") * F.col("most") < MOST)
    scale = F.pow(F.lit(10.0), F.least(F.lit(15.0), F.floor(F.log10(MOST / F.col("most")))))
    weights = share.select("source", F.col("b").cast("long").alias("b"), F.when(whole, F.col("target")).otherwise(F.greatest(F.round(F.col("target") / F.col("sum") * scale), F.lit(1.0))).cast("long").alias("w"))
    tasks = weights.agg(F.sort_array(F.collect_list(F.struct("source", "w", "b"))).alias("s")).where("size(s) > 0")
    gcd = "aggregate(s, 0L, (g, x) -> aggregate(sequence(1, 100), struct(g AS a, x.w AS b), (p, i) -> if(p.b = 0, p, struct(p.b AS a, p.a % p.b AS b))).a)"
    tasks = tasks.withColumn("g", F.expr(gcd)).select(F.expr("transform(s, x -> struct(x.source AS source, x.w div g AS w, x.b AS b))").alias("s"))
    tasks = tasks.withColumn("total", F.expr("aggregate(s, 0L, (a, x) -> a + x.w)"))
    need = F.expr("array_max(transform(s, x -> (x.b * total + x.w - 1) div x.w))")
    tasks = tasks.withColumn("c", F.when(need.isNotNull(), F.least(need, F.col("total"))).otherwise(F.lit(cycle).cast("long")))
    # The state holds, by source, the blocks placed so far, and the order of sources by slot.
    # At slot t, block k is released if k * total <= t * w (+ less than w, for the floor); its deadline is ceil((k + 1) * total / w).
    step = """
        transform(array(array_min(filter(transform(s, (x, j) -> struct(
            if(a.k[j] * total <= t * x.w, 0, 1) AS early, ((a.k[j] + 1) * total + x.w - 1) div x.w AS due, j AS j)), z -> z.early = 0))),
          b -> struct(transform(a.k, (v, j) -> if(j = b.j, v + 1, v)) AS k, concat(a.o, array(b.j)) AS o))[0]"""
    every = F.expr(f"""
      aggregate(sequence(0L, (c - 1) div {int(cycle)}), struct(transform(s, x -> 0L) AS k, cast(array() AS array<array<int>>) AS o), (done, n) ->
        transform(array(aggregate(sequence(n * {int(cycle)}, least((n + 1) * {int(cycle)}, c) - 1), struct(done.k AS k, cast(array() AS array<int>) AS o), (a, t) -> {step})),
          y -> struct(y.k AS k, concat(done.o, array(y.o)) AS o))[0]).o""")
    slots = tasks.select("s", "total", "c", F.posexplode(every).alias("n", "o")).select("s", "total", "c", "n", F.posexplode("o").alias("at", "j"))
    own = slots.select(F.expr("s[j].source").alias("source"), F.expr("s[j].w").alias("weight"), "total", F.col("c").alias("cycle"), F.expr(f"n * {int(cycle)}L + at").alias("slot"))
    by = W.partitionBy("source")
    return own.withColumn("q", F.count(F.lit(1)).over(by)).withColumn("i", F.row_number().over(by.orderBy("slot")) - 1)


def mix(docs: DataFrame, targets: DataFrame | None = None, block: int | None = None, cycle: int = 1000, power: float = 0.5) -> DataFrame:
    """doc_id, source, rank, block, release, deadline, slot, place: the reading order is (slot, place).

    targets: (source, target); by default the size of a source to the given power. block: documents of a block, by default
    BLOCK, or more where that makes more than BLOCKS blocks. A null source is a source
    of its own. Sources without a positive target, and repeated targets, get no slot: their rows stay, with null
    slots. All rows stay; when a source runs out, its later slots are empty. Ties of doc_id rank side by side.
    """
    rows = docs.select("doc_id", "source", F.md5(F.col("doc_id").cast("string")).alias("h"))
    rows = rows.withColumn("h", F.coalesce("h", F.lit("")))
    counts = rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
    total = docs.count()
    block = block or max(BLOCK, -(-total // BLOCKS))
    digits = max(0, math.ceil(math.log(max(1, total / RANGE_ROWS), 16)))
    rows = rows.withColumn("range", F.substring("h", 1, digits))
    offsets = rows.groupBy("source", "range").agg(F.count(F.lit(1)).alias("m")).withColumn("before", F.sum("m").over(W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)))
    within = rows.withColumn("r", F.row_number().over(W.partitionBy("source", "range").orderBy("h", "doc_id")) - 1)
    o = offsets.select(F.col("source").alias("o_source"), F.col("range").alias("o_range"), F.coalesce("before", F.lit(0)).alias("before"))
    ranked = within.join(o, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("range") == F.col("o_range"))).select("doc_id", "source", (F.col("r") + F.col("before")).cast("long").alias("rank"))
    if targets is None:
        targets = counts.select("source", F.pow(F.col("n").cast("double"), F.lit(power)).alias("target"))
    else:
        targets = targets.groupBy("source").agg(F.sum("target").cast("double").alias("target"))
    sizes = counts.select(F.col("source").alias("n_source"), F.expr(f"(n + {int(block) - 1}) div {int(block)}").alias("blocks"))
    sized = targets.join(sizes, F.col("source").eqNullSafe(F.col("n_source")), "left").select("source", "target", F.coalesce("blocks", F.lit(0)).alias("blocks"))
    slots = cut(plan(sized, cycle))
    # one row per source
    quota = small_enough(slots.groupBy(F.col("source").alias("q_source")).agg(F.max("q").alias("q"), F.max("weight").alias("weight"), F.max("total").alias("total"), F.max("cycle").alias("c")))
    at = small_enough(slots.select(F.col("source").alias("a_source"), F.col("i").cast("long").alias("a_i"), F.col("slot").alias("a_slot")))
    j = ranked.withColumn("block", F.expr(f"rank div {int(block)}")).join(quota, F.col("source").eqNullSafe(F.col("q_source")), "left")
    j = j.join(at, F.col("source").eqNullSafe(F.col("a_source")) & (F.expr("block % q") == F.col("a_i")), "left")
    return j.select(
        "doc_id",
        "source",
        "rank",
        "block",
        F.expr("(block * total) div weight").alias("release"),
        F.expr("((block + 1) * total + weight - 1) div weight").alias("deadline"),
        F.expr("(block div q) * c + a_slot").alias("slot"),
        F.expr(f"rank % {int(block)}").alias("place"),
    )


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, source FROM documents),
n AS (SELECT source, sqrt(count(*)::DOUBLE) AS target, (count(*) + 7) // 8 AS b FROM d GROUP BY source),
su AS (SELECT sum(target) AS total FROM n),
mo AS (SELECT total, greatest(max(b * total / target), 1000.0) + 2 AS most, bool_and(target = floor(target)) AS ints FROM n, su GROUP BY total),
sc AS (SELECT total, ints AND total * most < 4e18 AS whole, pow(10.0, least(15.0, floor(log10(4e18 / most)))) AS scale FROM mo),
ro AS (SELECT source, b, CASE WHEN whole THEN target ELSE greatest(round(target / total * scale), 1.0) END::BIGINT AS w FROM n, sc),
gc AS (SELECT list_reduce(list(w), lambda x, y: gcd(x, y)) AS g FROM ro),
l AS (SELECT list(source ORDER BY source NULLS FIRST) AS s, list((w // g)::BIGINT ORDER BY source NULLS FIRST) AS q, list(b ORDER BY source NULLS FIRST) AS b,
  sum(w // g)::BIGINT AS c FROM ro, gc),
m AS (SELECT s, q, c, least(c, list_max(list_transform(q, lambda y, i: (b[i] * c + y - 1) // y)))::BIGINT AS slots FROM l),
st AS (
  SELECT 0::BIGINT AS t, list_transform(q, lambda y: 0::BIGINT) AS k, 0::BIGINT AS j FROM m
  UNION ALL
  SELECT t + 1, list_transform(k, lambda v, i: CASE WHEN i = b THEN v + 1 ELSE v END), b FROM (
    SELECT st.t, st.k, list_min(list_filter(list_transform(m.q, lambda y, i:
      CASE WHEN st.k[i] * m.c <= st.t * y THEN (((st.k[i] + 1) * m.c + y - 1) // y) * 1000000 + i END), lambda z: z IS NOT NULL)) % 1000000 AS b
    FROM st, m WHERE st.t < m.slots)
),
sl AS (SELECT m.s[st.j] AS source, m.q[st.j] AS w, m.c AS c, m.slots AS slots, st.t - 1 AS slot, row_number() OVER (PARTITION BY st.j ORDER BY st.t) - 1 AS i,
    count(*) OVER (PARTITION BY st.j) AS n FROM st, m WHERE st.t > 0),
r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(doc_id::VARCHAR), doc_id) - 1 AS rank FROM d)
SELECT r.doc_id, r.source, r.rank, r.rank // 8 AS block, (r.rank // 8 * c) // w AS release, ((r.rank // 8 + 1) * c + w - 1) // w AS deadline,
  (r.rank // 8 // n) * slots + sl.slot AS slot, r.rank % 8 AS place
FROM r JOIN sl ON sl.source IS NOT DISTINCT FROM r.source AND sl.i = r.rank // 8 % n
"""
