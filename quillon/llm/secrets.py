"""Secret scans with DataFrame functions only: fixed patterns, and a battery of randomness tests.

Patterns give the base spans row by row. Beside them, every long run of key characters is a candidate:
its encoding is inferred from its alphabet, and it must look uniformly random in that alphabet by
three tests (chi-squared of the counts, runs above and below the middle, serial correlation).
What then speaks against an ordinary long word is how much smaller its chi-squared, and how
much larger its number of runs of character classes is than words of the same length would have;
the combined chance, which falls with length, goes through Benjamini-Hochberg control over all candidates of the corpus, on a fixed grid
of chances. Only positions of what is found are grouped by document; texts are never shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillon.llm.common import cut

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{16,}={0,2}"

_LOW, _UP, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: name, pattern of the whole token, alphabet, excess of the sum of squared shares over uniform in ordinary words of it
ENCODINGS = (
    ("decimal", r"^[0-9]+$", _DIGITS, 0.6),
    ("hex", r"^[0-9a-f]+$", _DIGITS + "abcdef", 0.6),
    ("hex-upper", r"^[0-9A-F]+$", _DIGITS + "ABCDEF", 0.6),
    ("lower", r"^[a-z]+$", _LOW, 0.72),
    ("upper", r"^[A-Z]+$", _UP, 0.72),
    ("base32", r"^[A-Z2-7]+$", _UP + "234567", 1.1),
    ("base36", r"^[0-9a-z]+$", _DIGITS + _LOW, 1.4),
    ("letters", r"^[A-Za-z]+$", _UP + _LOW, 2.4),
    ("base62", r"^[0-9A-Za-z]+$", _UP + _LOW + _DIGITS, 3.1),
    ("base64", r"^[0-9A-Za-z+/]+$", _UP + _LOW + _DIGITS + "+/", 3.2),
    ("base64url", r"^[0-9A-Za-z_-]+$", _UP + _LOW + _DIGITS + "-_", 3.2),
)
#: Chance that neighbouring characters of an ordinary word are of different classes.
CHANGE = 0.1
_ANY = ("mixed", "", _UP + _LOW + _DIGITS + "+/-_", 3.4)


#: Matches that are walked one after the other; the walks of a text's parts are put together afterwards.
WALK = 256


def _spans(t: Column, pattern: str, kind: int, value: int | None = None, least: int = 0) -> Column:
    """Array of (s, e, k, m) of the leftmost non-overlapping matches m, in code points; of those whose group value has least characters.

    Appending to an array copies it, so matches are walked WALK at a time, and each part is then moved to where it starts:
    time grows with the text.
    """
    matches = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    lengths = F.transform(matches, lambda m: F.char_length(m))
    before = F.transform(F.split(t, pattern, -1), lambda p: F.char_length(p))
    sizes = F.transform(F.regexp_extract_all(t, F.lit(pattern), F.lit(value)), lambda m: F.char_length(m)) if value else lengths
    empty = F.array().cast("array<struct<s:int,e:int,k:int,m:string>>")
    z = F.arrays_zip(before.alias("b"), lengths.alias("n"), sizes.alias("v"), matches.alias("m"))

    def walk(part: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), empty.alias("out"))
        place = lambda a, x: F.struct((a["at"] + x["b"]).alias("s"), (a["at"] + x["b"] + x["n"]).alias("e"), F.lit(kind).alias("k"), x["m"].alias("m"))
        return F.aggregate(part, start, lambda a, x: F.struct((a["at"] + x["b"] + F.coalesce(x["n"], F.lit(0))).alias("at"), F.when(x["v"] >= least, F.concat(a["out"], F.array(place(a, x)))).otherwise(a["out"]).alias("out")))

    def together(parts: Column) -> Column:
        none = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("starts"))
        starts = F.aggregate(parts, none, lambda a, p: F.struct((a["at"] + p["at"]).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")))["starts"]
        moved = lambda p, s: F.transform(p["out"], lambda x: F.struct((x["s"] + s).alias("s"), (x["e"] + s).alias("e"), x["k"].alias("k"), x["m"].alias("m")))
        return F.flatten(F.zip_with(parts, starts, moved))

    # arrays of one element name what is used more than once
    parts = F.transform(F.array(z), lambda a: F.transform(F.sequence(F.lit(0), F.floor((F.size(a) - 1) / WALK).cast("int")), lambda c: walk(F.slice(a, c * WALK + 1, F.lit(WALK)))))
    return F.when(t.rlike(pattern), F.transform(parts, together)[0]).otherwise(empty)


def _ordered(spans: Column) -> Column:
    """(s, e, k) by start, then kind."""
    by = F.array_sort(F.transform(spans, lambda x: F.struct(x["s"].alias("s"), x["k"].alias("k"), x["e"].alias("e"))))
    return F.transform(by, lambda x: F.struct(x["s"].alias("s"), x["e"].alias("e"), x["k"].alias("k")))


def base_spans(docs: DataFrame) -> DataFrame:
    """docs' doc_id and text (null: empty) with th (its hash) and base, the spans of the fixed patterns in order."""
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    base = F.concat(_spans(F.col("t"), ASSIGN, 0, 2, 12), _spans(F.col("t"), ACCESS, 1), _spans(F.col("t"), HEX, 2))
    return t.select("doc_id", F.xxhash64("t").alias("th"), "t", _ordered(base).alias("base"))


def _phi(z: Column) -> Column:
    """Normal distribution function: the density times a polynomial in 1 / (1 + 0.23 |z|) or, in the tails, a continued fraction."""
    x = F.least(F.lit(37.0), F.abs(z))
    t = 1 / (1 + 0.2316419 * x)
    near = t * (0.319381530 + t * (-0.356563782 + t * (1.781477937 + t * (-1.821255978 + t * 1.330274429))))
    far = 1 / (x + 1 / (x + 2 / (x + 3 / (x + 4 / (x + 0.65)))))
    tail = F.exp(-x * x / 2) * 0.3989422804014327 * F.when(x < 3, near).otherwise(far)
    return F.when(z > 0, 1 - tail).otherwise(tail)


def battery(tokens: DataFrame) -> DataFrame:
    """tokens (token string) with encoding, n, chi2, z_chi, z_runs, z_serial, random (passes all three) and chance.

    chance: how likely an ordinary word of the token's length looks as random (Fisher's combination of two chances); constant tokens have infinite z.
    """
    core = F.regexp_replace("token", "=+$", "")
    name, alphabet, excess = F.lit(_ANY[0]), F.lit(_ANY[2]), F.lit(_ANY[3])
    for n, pattern, letters, x in reversed(ENCODINGS):
        is_ = core.rlike(pattern)
        name, alphabet, excess = F.when(is_, n).otherwise(name), F.when(is_, letters).otherwise(alphabet), F.when(is_, x).otherwise(excess)
    x = tokens.withColumns({"core": core, "encoding": name, "alphabet": alphabet, "excess": excess})
    x = x.withColumns({"n": F.char_length("core"), "k": F.char_length("alphabet"), "at": F.transform(F.split("core", ""), lambda c: F.instr(F.col("alphabet"), c))})
    x = x.withColumn("at", F.filter("at", lambda v: v > 0))
    zero = F.lit(0.0)
    same = F.regexp_extract_all(F.array_join(F.array_sort(F.split("core", "")), ""), F.lit(r"((.)\2*)"), F.lit(1))
    squares = F.aggregate(same, zero, lambda a, c: a + F.pow(F.char_length(c).cast("double"), F.lit(2.0)))
    x = x.withColumn("chi2", F.col("k") * squares / F.col("n") - F.col("n"))
    df = F.col("k") - 1
    x = x.withColumn("z_chi", (F.pow(F.greatest(F.col("chi2"), zero) / df, F.lit(1 / 3)) - (1 - F.lit(2.0) / (9 * df))) / F.sqrt(F.lit(2.0) / (9 * df)))
    pairs = F.arrays_zip(F.slice("at", F.lit(1), F.col("n") - 1).alias("a"), F.slice("at", F.lit(2), F.col("n") - 1).alias("b"))
    x = x.withColumns({"high": F.size(F.filter("at", lambda v: v * 2 > F.col("k"))).cast("double"), "pairs": pairs})
    x = x.withColumn("low", F.col("n") - F.col("high"))
    runs = 1.0 + F.size(F.filter("pairs", lambda p: (p["a"] * 2 > F.col("k")) != (p["b"] * 2 > F.col("k"))))
    mean = 2 * F.col("high") * F.col("low") / F.col("n") + 1
    var = (mean - 1) * (mean - 2) / (F.col("n") - 1)
    x = x.withColumn("z_runs", F.when(var > 0, (runs - mean) / F.sqrt(var)).otherwise(F.lit(float("inf"))))
    mid = F.aggregate("at", zero, lambda a, v: a + v) / F.col("n")
    x = x.withColumn("mid", mid)
    spread = F.aggregate("at", zero, lambda a, v: a + (v - F.col("mid")) * (v - F.col("mid")))
    lag = F.aggregate("pairs", zero, lambda a, p: a + (p["a"] - F.col("mid")) * (p["b"] - F.col("mid")))
    x = x.withColumn("spread", spread)
    x = x.withColumn("z_serial", F.when(F.col("spread") > 0, lag / F.col("spread") * F.sqrt(F.col("n").cast("double"))).otherwise(F.lit(float("inf"))))
    lam = F.col("n") * F.col("excess")
    # Runs of character classes: ordinary words seldom change between letters, cases and digits.
    classes = F.translate("core", _LOW + _UP + _DIGITS + "+/-_", "a" * 26 + "A" * 26 + "0" * 10 + "----")
    changes = F.char_length(F.regexp_replace(classes, r"(.)\1+", "$1")) - 1
    gaps = F.col("n") - 1
    flat = _phi((F.col("chi2") - df - lam) / F.sqrt(2 * df + 4 * lam))
    mixed = _phi(-(changes - gaps * CHANGE) / F.sqrt(gaps * CHANGE * (1 - CHANGE)))
    x = x.withColumn("both", flat * mixed)
    x = x.withColumn("chance", F.col("both") * (1 - F.log("both")))
    ok = (F.abs("z_chi") <= 3) & (F.abs("z_runs") <= 3) & (F.abs("z_serial") <= 3)
    return x.withColumn("random", ok).drop("core", "alphabet", "excess", "at", "k", "pairs", "high", "low", "mid", "spread", "both")


GRID = 40


def discoveries(tested: DataFrame, q: float = 0.05) -> DataFrame:
    """Those of tested (random, chance) that pass Benjamini-Hochberg at rate q over all rows, with chances rounded up to 1/GRID decades."""
    step = F.floor(-F.log10(F.greatest("chance", F.lit(1e-12))) * GRID).cast("int")
    step = F.when(F.col("random"), step).otherwise(-1)
    x = tested.withColumn("step", step)
    # at most 12 * GRID + 2 rows
    bins = x.groupBy("step").agg(F.count(F.lit(1)).alias("c"))
    w = W.orderBy(F.desc("step"))
    # over the bins, not the rows
    cum = bins.select("step", F.sum("c").over(w).alias("rank"), F.sum("c").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("m"))
    good = cum.where((F.col("step") >= 0) & (F.pow(F.lit(10.0), -F.col("step") / GRID) <= q * F.col("rank") / F.col("m")))
    least = good.agg(F.min("step")).first()[0]
    return x.where(F.col("step") >= F.lit(least)).drop("step")


def random_spans(docs: DataFrame, q: float = 0.05) -> DataFrame:
    """doc_id, th, s, e of the tokens found by the battery."""
    t = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"))
    # the hash first: beside the spans, it would be taken of the whole text for each of them
    c = t.select("doc_id", F.xxhash64("t").alias("th"), _spans(F.col("t"), CANDIDATE, 3).alias("xs"))
    # outer, or a filter on the spans' number goes below and searches every text twice
    c = c.select("doc_id", "th", F.explode_outer("xs").alias("x")).where("x is not null")
    c = c.select("doc_id", "th", F.col("x.s").alias("s"), F.col("x.e").alias("e"), F.col("x.m").alias("token"))
    # positions and statistics of candidates only, used twice below
    return discoveries(cut(battery(c)), q).select("doc_id", "th", "s", "e", "encoding")


def secrets(docs: DataFrame, q: float = 0.05) -> DataFrame:
    """doc_id, base and spans (arrays of s, e, k; k indexes KINDS) for every row; spans of the battery inside base ones are left out.

    Null and empty texts have no spans. Repeated rows give repeated results. Other columns are ignored.
    """
    # positions only, used twice
    base = cut(base_spans(docs).select("doc_id", "th", "base"))
    fixed = base.select("doc_id", "th", F.explode("base").alias("x")).select("doc_id", "th", "x.s", "x.e", F.lit(False).alias("new"))
    found = random_spans(docs, q).distinct().select("doc_id", "th", "s", "e", F.lit(True).alias("new"))
    # a span lies inside another if one that starts no later ends no earlier
    before = W.partitionBy("doc_id", "th").orderBy("s").rangeBetween(W.unboundedPreceding, 0)
    beyond = fixed.unionByName(found).withColumn("far", F.max(F.when(~F.col("new"), F.col("e"))).over(before)).where("new and coalesce(far, 0) < e")
    more = beyond.groupBy("doc_id", "th").agg(F.collect_list(F.struct("s", "e", F.lit(3).alias("k"))).alias("more"))
    more = more.select(F.col("doc_id").alias("q_id"), F.col("th").alias("q_th"), "more")
    j = base.join(more, F.col("doc_id").eqNullSafe(F.col("q_id")) & (F.col("th") == F.col("q_th")), "left")
    both = F.concat("base", F.coalesce("more", F.array().cast("array<struct<s:int,e:int,k:int>>")))
    return j.select("doc_id", "base", _ordered(both).alias("spans"))


def _join(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", names[x["k"]], x["s"].cast("string"), x["e"].cast("string"))), ",")


def digest(docs: DataFrame, q: float = 0.05) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = secrets(docs, q)
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(3)], F.sha2(_join(F.col("base")).cast("binary"), 256).alias("base_sha256"), _join(F.col("spans")).alias("spans"))
