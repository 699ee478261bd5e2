"""One query per operator, over whole tables, and its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions import scoring as S
from quillon.functions.html import FLAGS, area, body_cap, element
from quillon.functions.images import data_uri_images
from quillon.functions.numeric import round_exact_sql
from quillon.functions.reply import parse_reply
from quillon.functions.text import PROMPT_CAP, cap, clean_string, strip, truncate_text
from quillon.operators import mails as M
from quillon.plans.views import MAIL, OCR_P, P, table, v_blocks, v_flags, v_mail, v_ocr, v_replied, v_scored
from quillon.sources.eml import read_mails
from quillon.sources.providers import by_lookup, interpret
from quillon.sources.shared import cut, scratch
from quillon.sources.sinks import load_full_report, load_json, mail_reports, report_entries, save_json, write_full_report
from quillon.sources.writer import write_forms, write_mails

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
R3 = lambda x: round_exact_sql(x, 3, 2)
R1 = lambda x: round_exact_sql(x, 1)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(spark, sf_dir)
            # positions and lengths as the oracle types them
            return df.withColumns({c: F.col(c).cast("long") for c in ("block_idx", "n", "image_idx") if c in df.columns})

        QUERIES[f.__name__] = run
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# --- the views in SQL

_MAIL = f"mail AS (SELECT doc_id, {MAIL} AS html FROM (SELECT doc_id, coalesce(text, '') AS s FROM documents))"
_TABLE, _SECTION, _LISTS = f"({element('table')})", f"({element('div', area(chr(34) + 2 * chr(39)))})", f"({element('ul')}|{element('ol')})"
_BLOCKS = rf"""{_MAIL},
capped AS (SELECT doc_id, CASE WHEN length(html) > 25000 THEN substring(html, 1, 25000) || '...' ELSE html END AS h FROM mail),
parts AS (SELECT doc_id, h, regexp_extract_all(h, '{_TABLE}', 1, 'si') AS t, regexp_extract_all(h, '{_SECTION}', 1, 'si') AS d,
  regexp_extract_all(h, '{_LISTS}', 1, 'si') AS l FROM capped),
blocks AS (
  SELECT doc_id, i - 1 AS block_idx, 'table' AS type, t[i] AS content, 'table_' || (i - 1) AS position FROM (SELECT *, unnest(range(1, len(t) + 1)) AS i FROM parts)
  UNION ALL SELECT doc_id, len(t) + i - 1, 'div_section', d[i], 'section_' || (i - 1) FROM (SELECT *, unnest(range(1, len(d) + 1)) AS i FROM parts)
  UNION ALL SELECT doc_id, len(t) + len(d) + i - 1, 'list', l[i], 'list_' || (i - 1) FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM parts)
  UNION ALL SELECT doc_id, 0, 'text_block', h, 'full_text' FROM parts WHERE len(t) + len(d) + len(l) = 0)"""
_RULES = {
    "template_variable": r"regexp_matches(content, '\{\{\s*\w+\s*\}\}')",
    "repetitive_pattern": r"len(rw) - len(list_distinct(rw)) >= 2",
    "suspicious_comment": r"regexp_matches(content, '<!--[^>]*(generated|template)', 'is')",
    "too_deep_nesting": "coalesce(list_max(list_transform(range(1, len(tg) + 1), lambda i: 2 * len(list_filter(tg[1:i], lambda x: x = '<table')) - i)), 0) > 5",
    "duplicate_styles": "len(st) - len(list_distinct(st)) >= 2",
    "empty_cell": r"regexp_matches(content, '<td[^>]*>(\s|&nbsp;)*</td>', 'is')",
    "inline_style_overuse": "len(list_filter(st, lambda s: len(list_filter(string_split(s, ';'), lambda x: trim(x) <> '')) > 3)) > 0",
    "suspicious_link": r"regexp_matches(content, 'href=[\"''][^\"'']*[?&](url|redirect)=', 'is')".replace('\\"', '"'),
    "missing_alt": "len(list_filter(im, lambda x: NOT contains(lower(x), 'alt='))) > 0",
    "structural_redundancy": r"regexp_matches(content, '<div[^>]*>\s*<div[^>]*>\s*<div', 'is')",
}
_FLAGS = rf"""{_BLOCKS},
lists AS (SELECT *, regexp_extract_all(content, '(<(?:tr|li)[^>]*>.*?</(?:tr|li)>)', 1, 'si') AS rw, regexp_extract_all(lower(content), '(</?table)', 1) AS tg,
  regexp_extract_all(content, 'style="([^"]*)"', 1, 'si') AS st, regexp_extract_all(content, '(<img[^>]*>)', 1, 'si') AS im FROM blocks),
flags AS (SELECT doc_id, block_idx, type, position, {", ".join(f"{v} AS {k}" for k, v in _RULES.items())} FROM lists)"""
_NAMES = [n.lower() for n in FLAGS]
_LIST = "list_filter([" + ", ".join(f"CASE WHEN {n} THEN '{n.upper()}' END" for n in _NAMES) + "], lambda x: x IS NOT NULL)"
_W = {k: f"{v!r}::DOUBLE" for k, v in S.WEIGHTS.items()}


def _scored(weights: dict[str, float] = S.WEIGHTS) -> str:
    bools = dict(zip(list(S.WEIGHTS)[1:], _NAMES[:6], strict=True))
    cols = ", ".join(f"CASE WHEN {v} THEN 1e0 ELSE 0e0 END AS {k}" for k, v in bools.items())
    dot = " + ".join(f"{k} * {w!r}::DOUBLE" for k, w in weights.items())
    mean = "(" + " + ".join(S.WEIGHTS) + ") / 7e0"
    var = "(" + " + ".join(f"({k} - mean) * ({k} - mean)" for k in S.WEIGHTS) + ") / 7e0"
    return f"""{_FLAGS},
sig AS (SELECT doc_id, block_idx, type, position, p, CASE WHEN p > 1 THEN p / 1e2 ELSE p * 1e0 END AS llm_score, {cols}, flags
  FROM (SELECT *, {P} AS p, {_LIST} AS flags FROM flags)),
dot AS (SELECT *, {dot} AS score, {mean} AS mean FROM sig),
scored AS (SELECT *, {R1(R3("score") + " * 1e2")} AS ai_score, {R1("score * 1e2")} AS pct, {var} AS var FROM dot)"""


def _label(x: str, limits: tuple[float, float]) -> str:
    return f"CASE WHEN {x} >= {limits[0]!r}::DOUBLE THEN '{S.LABELS[0]}' WHEN {x} >= {limits[1]!r}::DOUBLE THEN '{S.LABELS[1]}' ELSE '{S.LABELS[2]}' END"


_ODD = "list_filter([" + ", ".join(f"CASE WHEN {k} > 0 THEN '{v}' END" for k, v in S.ANOMALIES) + "], lambda x: x IS NOT NULL)"
_WHY = (
    f"'{S.INDEX}' || pct || '/100.' || CASE WHEN llm_score > 0.7::DOUBLE THEN ' {S.LIKELY}' ELSE '' END"
    + "".join(f" || CASE WHEN {k} > 0 THEN ' {v}' ELSE '' END" for k, v in S.SENTENCES)
    + f" || CASE WHEN len({_ODD}) > 0 THEN ' {S.ODD[0]}' || array_to_string({_ODD}, ', ') || '{S.ODD[1]}' ELSE '' END"
)
_CONFIDENCE = "round(greatest(0.5::DOUBLE, least(0.99::DOUBLE, 0.98::DOUBLE - var * 0.8::DOUBLE)) * 1e2, 1) || '%'"
_OCR = f"""ocr AS (SELECT doc_id, 'img_' || doc_id AS source, CASE WHEN doc_id % 3 = 0 AND doc_id % 9 <> 0 THEN coalesce(b.text, '') ELSE '  ' END AS text, {OCR_P} AS q
  FROM documents LEFT JOIN (SELECT item_id, text FROM benchmark) b ON b.item_id = doc_id % (SELECT count(*) FROM benchmark)),
ocrp AS (SELECT doc_id, source, text, trim(text) <> '' AS has_ocr, CASE WHEN trim(text) = '' THEN 0e0 WHEN q > 1 THEN q / 1e2 ELSE q * 1e0 END AS op FROM ocr)"""
_MEAN = "means AS (SELECT doc_id, sum(round(ai_score * 10)::BIGINT) / 1e1 / count(*) AS mean, count(*) AS n FROM scored GROUP BY doc_id)"
_BLEND = f"""{_OCR}, {_MEAN},
bl AS (SELECT m.doc_id, mean, n, mean / 1e2 AS h, op AS o, has_ocr, CASE WHEN NOT has_ocr THEN 1e0 WHEN mean / 1e2 < 0.3::DOUBLE THEN 0.3::DOUBLE ELSE 0.5::DOUBLE END AS wh,
  CASE WHEN NOT has_ocr THEN 0e0 WHEN mean / 1e2 < 0.3::DOUBLE THEN 0.7::DOUBLE ELSE 0.5::DOUBLE END AS wo FROM means m JOIN ocrp USING (doc_id)),
fin AS (SELECT *, greatest(0e0, least(1e0, h * wh + o * wo)) AS f FROM bl)"""

# --- blocks


@query(f"""SELECT page_id, i - 1 AS block_idx, md5(l[i]) AS md5, length(l[i]) AS n FROM (SELECT page_id, l, unnest(range(1, len(l) + 1)) AS i FROM (
  SELECT page_id, regexp_extract_all(CASE WHEN length(html) > 25000 THEN substring(html, 1, 25000) || '...' ELSE html END, '{_LISTS}', 1, 'si') AS l FROM pages))""")
def split_lists_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = M.blocks(table(spark, sf_dir, "pages"), "page_id").where("type = 'list'")
    return b.select("page_id", F.regexp_extract("position", r"(\d+)", 1).cast("int").alias("block_idx"), F.md5("content").alias("md5"), F.char_length("content").alias("n"))


@query(f"WITH {_BLOCKS} SELECT doc_id, block_idx, type, position, md5(content) AS md5, length(content) AS n FROM blocks")
def split_all_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_blocks(spark, sf_dir).select("doc_id", "block_idx", "type", "position", F.md5("content").alias("md5"), F.char_length("content").alias("n"))


@query("""SELECT doc_id, length(c) AS n, md5(c) AS md5 FROM (SELECT doc_id, CASE WHEN length(t) > 25000 THEN substring(t, 1, 25000) || '...' ELSE t END AS c
  FROM (SELECT doc_id, repeat(text, 4) AS t FROM documents))""")
def body_cap_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", body_cap(F.repeat("text", 4)).alias("c"))
    return d.select("doc_id", F.char_length("c").alias("n"), F.md5("c").alias("md5"))


@query("SELECT doc_id, length(c) AS n, md5(c) AS md5 FROM (SELECT doc_id, CASE WHEN length(text) > 10000 THEN substring(text, 1, 10000) || '...' ELSE text END AS c FROM documents)")
def prompt_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", cap(F.col("text"), PROMPT_CAP).alias("c")).select("doc_id", F.char_length("c").alias("n"), F.md5("c").alias("md5"))


@query("SELECT doc_id, CASE WHEN length(text) > 500 THEN substring(text, 1, 500) || '...' ELSE coalesce(text, '') END AS preview FROM documents")
def preview_500(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", truncate_text(F.col("text")).alias("preview"))


@query("SELECT doc_id, coalesce(text, '') AS cleaned FROM documents")
def clean_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", clean_string(F.col("text")).alias("cleaned"))


# --- flags


def _flag(name: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return v_flags(spark, sf_dir).select("doc_id", "block_idx", name)

    run.__name__ = f"flag_{name}"
    query(f"WITH {_FLAGS} SELECT doc_id, block_idx, {name} FROM flags")(run)


for _n in _NAMES:
    _flag(_n)


# --- answers

_ANSWERS = ("0", "0.5", "1", "1.0001", "2", "85", '"85"', "85%", "null", "true", "-5", "101", "1000", "1e2", " 85 ", "abc")


@query(
    "WITH v AS (SELECT doc_id, ["
    + ", ".join(f"'{a}'" for a in _ANSWERS)
    + f"""][doc_id % {len(_ANSWERS)} + 1] AS raw FROM documents),
n AS (SELECT doc_id, raw, CASE WHEN raw = 'true' THEN 1e0 ELSE coalesce(try_cast(trim(raw) AS DOUBLE), 0e0) END AS x FROM v)
SELECT doc_id, raw, greatest(0e0, least(1e0, CASE WHEN x > 1 THEN x / 1e2 ELSE x END)) AS p FROM n"""
)
def normalize_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.element_at(F.array(*[F.lit(a) for a in _ANSWERS]), (F.col("doc_id") % len(_ANSWERS) + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", raw.alias("raw")).select("doc_id", "raw", S.normalize_probability(F.col("raw")).alias("p"))


_REPLY = """'Sure: {"ai_probability": ' || (doc_id % 101) || ', "flags": ["EMPTY_CELL", "F' || (doc_id % 3) || '"], "summary": "s' || (doc_id % 7) || '"} done' || CASE WHEN doc_id % 10 = 0 THEN ' {x}' ELSE '' END"""


@query(
    f"""WITH r AS (SELECT doc_id, regexp_extract({_REPLY}, '(\\{{.*\\}})', 1, 's') AS j FROM documents)
SELECT doc_id, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.ai_probability') ELSE '0' END AS ai_probability,
  CASE WHEN json_valid(j) THEN 'EMPTY_CELL|F' || (doc_id % 3) ELSE '' END AS flags, CASE WHEN json_valid(j) THEN json_extract_string(j, '$.summary') ELSE '' END AS summary FROM r"""
)
def parse_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", parse_reply(F.expr(_REPLY)).alias("r"))
    return d.select("doc_id", "r.ai_probability", F.array_join("r.flags", "|").alias("flags"), "r.summary")


@query(f"WITH {_FLAGS}, c AS (SELECT DISTINCT md5(content) AS md5, length(content) % 101 AS p FROM blocks) SELECT b.doc_id, b.block_idx, c.p::VARCHAR AS ai_probability, 'H' || c.p AS summary FROM blocks b JOIN c ON c.md5 = md5(b.content)")
def lookup_provider(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = v_blocks(spark, sf_dir)
    p = (F.char_length("content") % 101).cast("string")
    replies = b.select(F.md5("content").alias("md5"), p.alias("ai_probability"), F.array(F.lit("A")).alias("flags"), F.concat(F.lit("H"), p).alias("summary")).distinct()
    return by_lookup(b, replies).select("doc_id", "block_idx", "ai_probability", "summary")


# --- scoring


@query(f"WITH {_scored()} SELECT doc_id, block_idx, {', '.join(f'{k} > 0 AS {k}' for k in S.FLAG_OF)} FROM scored")
def feature_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    # names count whatever their case and outer white space
    r = v_replied(spark, sf_dir).withColumn("flags", F.transform("flags", lambda f: F.concat(F.lit(" \t"), F.lower(f), F.lit("\n"))))
    return r.select("doc_id", "block_idx", *[c.alias(k) for k, c in S.features(F.col("flags")).items()])


@query(f"WITH {_scored()} SELECT doc_id, block_idx, score, {R3('score')} AS score3, pct, ai_score FROM scored")
def block_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = v_scored(spark, sf_dir)
    return x.select("doc_id", "block_idx", "score", S.score3(F.col("score")).alias("score3"), S.percent(F.col("score")).alias("pct"), "ai_score")


@query(f"WITH {_scored()} SELECT doc_id, block_idx, {_label('score', S.BLOCK_LIMITS)} AS verdict FROM scored")
def block_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_scored(spark, sf_dir).select("doc_id", "block_idx", "verdict")


@query(f"WITH {_scored()} SELECT doc_id, block_idx, {_CONFIDENCE} AS confidence FROM scored")
def block_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_scored(spark, sf_dir).select("doc_id", "block_idx", "confidence")


@query(f"WITH {_scored()} SELECT doc_id, block_idx, {_WHY} AS explanation FROM scored")
def block_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_scored(spark, sf_dir).select("doc_id", "block_idx", F.col("engine_explanation").alias("explanation"))


@query(f"WITH {_scored()} SELECT doc_id, block_idx, {', '.join(f'{R3(k)} AS {k}' for k in S.WEIGHTS)} FROM scored")
def block_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_scored(spark, sf_dir).select("doc_id", "block_idx", *[S.score3(F.col(f"s_{k}")).alias(k) for k in S.WEIGHTS])


_CUSTOM = {"empty_cell": 0.5, "llm_score": 0.25, "template_variable": 0.25}


@query(f"WITH {_scored(_CUSTOM)} SELECT doc_id, block_idx, score FROM scored")
def custom_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_scored(spark, sf_dir, _CUSTOM).select("doc_id", "block_idx", "score")


@query(f"WITH {_scored()} SELECT doc_id, block_idx, p * 1e0 * {_W['llm_score']} AS part FROM scored")
def raw_llm_quirk(spark: SparkSession, sf_dir: str) -> DataFrame:
    # a probability in percent isn't scaled inside the vector
    r = v_replied(spark, sf_dir)
    none = {k: F.lit(False) for k in S.FLAG_OF}
    s = S.signals(F.col("ai_probability").cast("double"), none)
    return r.select("doc_id", "block_idx", S.score({"llm_score": s["llm_score"]}, {"llm_score": S.WEIGHTS["llm_score"]}).alias("part"))


# --- mails


def _mails(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.aggregate_mails(v_scored(spark, sf_dir), "doc_id", v_ocr(spark, sf_dir))


@query(f"WITH {_scored()}, {_MEAN} SELECT doc_id, {R1('mean')} AS html_ai_score FROM means")
def mail_html_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.aggregate_mails(v_scored(spark, sf_dir), "doc_id").select("doc_id", "html_ai_score")


@query(
    f"""WITH {_scored()}, one AS (SELECT doc_id, block_idx * 100 + i AS pos, flags[i] AS flag FROM (SELECT *, unnest(range(1, len(flags) + 1)) AS i FROM scored)),
f AS (SELECT doc_id, flag, min(pos) AS pos FROM one GROUP BY doc_id, flag)
SELECT s.doc_id, coalesce(string_agg(f.flag, '|' ORDER BY f.pos), '') AS flags FROM (SELECT DISTINCT doc_id FROM scored) s LEFT JOIN f ON f.doc_id = s.doc_id GROUP BY s.doc_id"""
)
def mail_global_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mails(spark, sf_dir).select("doc_id", F.array_join("global_flags", "|").alias("flags"))


@query(f"WITH {_scored()} SELECT doc_id, coalesce(string_agg(position, '|' ORDER BY block_idx) FILTER (WHERE ai_score >= 70), '') AS positions FROM scored GROUP BY doc_id")
def mail_high_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mails(spark, sf_dir).select("doc_id", F.array_join("high_risk_blocks.position", "|").alias("positions"))


@query(f"WITH {_scored()} SELECT doc_id, string_agg(position || '=' || ai_score, '|' ORDER BY block_idx) AS blocks FROM scored GROUP BY doc_id")
def mail_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mails(spark, sf_dir).select("doc_id", F.array_join(F.transform("blocks", lambda b: F.concat(b["position"], F.lit("="), b["ai_score"].cast("string"))), "|").alias("blocks"))


@query(f"WITH {_scored()}, {_BLEND} SELECT doc_id, n AS n_blocks, 1 AS images_count, has_ocr FROM fin")
def mail_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mails(spark, sf_dir).select("doc_id", F.size("blocks").cast("long").alias("n_blocks"), "ocr.images_count", "engine.signals.has_ocr")


@query(f"WITH {_scored()}, {_BLEND} SELECT doc_id, {R3('h')} AS html_score, {R3('o')} AS ocr_score, wh AS html_weight, wo AS ocr_weight, {R3('f')} AS final_score, {R1('f * 1e2')} AS global_ai_score FROM fin")
def mail_blend(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mails(spark, sf_dir).select("doc_id", "engine.signals.html_score", "engine.signals.ocr_score", "engine.signals.html_weight", "engine.signals.ocr_weight", "engine.final_score", "global_ai_score")


@query(f"WITH {_scored()}, {_BLEND} SELECT doc_id, {_label('f', S.MAIL_LIMITS)} AS verdict FROM fin")
def mail_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mails(spark, sf_dir).select("doc_id", "verdict")


@query(
    f"WITH {_scored()}, {_BLEND} SELECT doc_id, '{S.INDEX}' || {R1('f * 1e2')} || '/100. HTML: ' || {R1('h * 1e2')} || '/100. OCR: ' || {R1('o * 1e2')} || '/100. Веса: HTML ' || round(wh * 100)::INT || '%, OCR ' || round(wo * 100)::INT || '%.' AS explanation FROM fin"
)
def mail_explanation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mails(spark, sf_dir).select("doc_id", "engine.explanation")


@query(f"WITH {_scored()}, {_BLEND} SELECT verdict, count(*) AS n FROM (SELECT {_label('f', S.MAIL_LIMITS)} AS verdict FROM fin) GROUP BY verdict")
def mail_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mails(spark, sf_dir).groupBy("verdict").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {_scored()} SELECT count(DISTINCT doc_id) AS n_mails FROM scored")
def run_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _mails(spark, sf_dir).agg(F.count(F.lit(1)).alias("n_mails"))


@query(f"WITH {_scored()}, m AS (SELECT doc_id, sum(p) AS s, count(*) AS n FROM scored GROUP BY doc_id) SELECT doc_id, CAST((2 * s + n) // (2 * n) - CASE WHEN (2 * s + n) % (2 * n) = 0 AND ((2 * s + n) // (2 * n)) % 2 = 1 THEN 1 ELSE 0 END AS BIGINT) AS global_ai_score FROM m")
def legacy_global_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.legacy_global_score(v_replied(spark, sf_dir).withColumn("p", F.col("ai_probability").cast("long")), "doc_id")


@query(f"WITH {_scored()}, {_BLEND}, b AS (SELECT doc_id, string_agg(position || ':' || type || ':' || ai_score || ':' || array_to_string(flags, ','), '|' ORDER BY block_idx) AS blocks_summary FROM scored GROUP BY doc_id)"
    f" SELECT doc_id, 'doc ' || doc_id AS subject, CASE WHEN length(html) > 500 THEN substring(html, 1, 500) || '...' ELSE html END AS html_preview, {R1('mean')} AS html_ai_score, {R1('f * 1e2')} AS global_ai_score, blocks_summary FROM fin JOIN mail USING (doc_id) JOIN b USING (doc_id)")
def report_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    mails = v_mail(spark, sf_dir).withColumns({"subject": F.concat(F.lit("doc "), F.col("doc_id").cast("string")), "sender": F.lit("x")})
    r = mail_reports(mails, _mails(spark, sf_dir), "doc_id")
    short = F.transform("analysis.blocks_summary", lambda b: F.concat_ws(":", b["position"], b["block_type"], b["ai_score"].cast("string"), F.array_join(b["flags"], ",")))
    return r.select("doc_id", "email.subject", "email.html_preview", "analysis.html_ai_score", "analysis.global_ai_score", F.array_join(short, "|").alias("blocks_summary"))


# --- images


@query(f"""WITH {_OCR}, t AS (SELECT doc_id, CASE WHEN has_ocr THEN 'IMAGE: ' || source || chr(10) || trim(text, ' ' || chr(10) || chr(9) || chr(13)) ELSE '' END AS c FROM ocrp)
SELECT doc_id, CASE WHEN length(c) > 10000 THEN substring(c, 1, 10000) || '...' ELSE c END AS ocr_text FROM t""")
def ocr_text_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return v_ocr(spark, sf_dir).select("doc_id", M.ocr_text(F.col("results")).alias("ocr_text"))


@query("""WITH g AS (SELECT conv_id, string_agg('IMAGE: ' || role || chr(10) || text, chr(10) || chr(10) ORDER BY turn, role, text) AS c FROM conversations WHERE trim(text, ' ' || chr(10) || chr(9) || chr(13)) <> '' GROUP BY conv_id)
SELECT conv_id, length(c) AS n, md5(CASE WHEN length(c) > 10000 THEN substring(c, 1, 10000) || '...' ELSE c END) AS md5 FROM g""")
def ocr_text_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    # threads stand in for mails of several images
    one = F.struct("turn", F.col("role").alias("source"), "text")
    g = table(spark, sf_dir, "conversations").where(strip(F.col("text")) != "").groupBy("conv_id").agg(F.array_sort(F.collect_list(one)).alias("results"))
    whole = M.ocr_text(F.col("results"), 1_000_000_000)
    return g.select("conv_id", F.char_length(whole).alias("n"), F.md5(M.ocr_text(F.col("results"))).alias("md5"))


_RISK = ("['Phishing ']", "['aggressive advertising']", "['urgent_language', 'x']", "['other']", "['urgent language', 'SCAM']")


@query(f"""WITH f AS (SELECT doc_id, (doc_id * 13) % 101 * 1e0 AS p, [{", ".join(_RISK)}][doc_id % 5 + 1] AS fl FROM documents)
SELECT doc_id, greatest(p, CASE doc_id % 5 WHEN 0 THEN 90e0 WHEN 1 THEN 70e0 WHEN 2 THEN 55e0 WHEN 4 THEN 90e0 ELSE 0e0 END) AS risk FROM f""")
def ocr_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = F.element_at(F.array(*[F.expr(f"array({r[1:-1]})") for r in _RISK]), (F.col("doc_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "documents").select("doc_id", S.ocr_risk(F.expr(OCR_P).cast("double"), flags).alias("risk"))


@query("""SELECT doc_id, 0::BIGINT AS image_idx, length(text) AS n, md5(text) AS md5 FROM documents WHERE text <> ''""")
def data_uri_images_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    # every text as one image, broken over lines, beside one that doesn't decode
    payload = F.regexp_replace(F.base64(F.col("text").cast("binary")), "(.{76})", "$1\n")
    html = F.concat(F.lit('<img src="data:image/png;base64,'), payload, F.lit('"><img src="DATA:image/gif;base64,AAA">'))
    x = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(data_uri_images(html)).alias("image_idx", "b"))
    text = F.decode(F.col("b"), "UTF-8")
    return x.select("doc_id", "image_idx", F.char_length(text).alias("n"), F.md5(text).alias("md5"))


@query("""WITH m AS (SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN '  short ' ELSE text END AS html, CASE WHEN doc_id % 8 = 0 THEN 1 ELSE 0 END AS images FROM documents)
SELECT doc_id, CASE WHEN length(trim(html, ' ' || chr(10) || chr(9) || chr(13))) < 10 THEN '' ELSE html END AS html FROM m WHERE NOT (length(trim(html, ' ' || chr(10) || chr(9) || chr(13))) < 10 AND images = 0)""")
def drop_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "documents").select("doc_id", F.expr("CASE WHEN doc_id % 4 = 0 THEN '  short ' ELSE text END").alias("html"), F.expr("CASE WHEN doc_id % 8 = 0 THEN array(1) ELSE cast(array() AS array<int>) END").alias("images"))
    return M.drop_rule(m).select("doc_id", "html")


# --- files


@query("SELECT page_id || '.eml' AS file, 'Тема ' || page_id AS subject, 'a@b.example' AS sender, length(html) AS n, md5(html) AS md5 FROM pages")
def eml_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages written as mails by the executors into a shared folder, and read back by the folder scan."""
    pages = table(spark, sf_dir, "pages").select(F.concat(F.col("page_id").cast("string"), F.lit(".eml")).alias("file"), F.concat(F.lit("Тема "), F.col("page_id").cast("string")).alias("subject"), F.lit("a@b.example").alias("sender"), "html")
    with scratch(spark) as folder:
        write_mails(pages, folder)
        return cut(read_mails(spark, folder).select("file", "subject", "sender", *_body()))


def _body() -> list:
    # a message's text ends in a line break
    body = F.regexp_replace("html", r"\n$", "")
    return [F.char_length(body).alias("n"), F.md5(body).alias("md5")]


_FORMS = """f AS (SELECT page_id, page_id % 8 AS k, CASE page_id % 8 WHEN 0 THEN html WHEN 1 THEN html WHEN 2 THEN 'plain words of page ' || page_id WHEN 4 THEN 'plain words of page ' || page_id
    WHEN 7 THEN html || '<img src="data:image/png;base64,' || to_base64(encode('data of ' || page_id)) || '">' ELSE '' END AS html, md5('image of ' || page_id) AS image FROM pages)"""


def _forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    data = F.concat(F.lit('<img src="data:image/png;base64,'), F.base64(F.concat(F.lit("data of "), F.col("page_id").cast("string")).cast("binary")), F.lit('">'))
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("n"), F.when(F.col("page_id") % 8 == 7, F.concat("html", data)).otherwise(F.col("html")).alias("html"))


@query(f"""WITH {_FORMS} SELECT page_id || '.eml' AS file, CASE WHEN k = 1 THEN 'Без темы' ELSE 'Тема ' || page_id END AS subject,
  CASE WHEN k = 1 THEN 'Неизвестный отправитель' ELSE page_id || '@b.example' END AS sender, length(html) AS n, md5(html) AS md5,
  CASE k WHEN 0 THEN 'p' || page_id || '.png <cid> ' || image WHEN 4 THEN 'image/gif - ' || image WHEN 5 THEN 'image/gif - ' || image
    WHEN 7 THEN '<c' || page_id || '> <c' || page_id || '> ' || image || ',data_uri_0 - ' || md5('data of ' || page_id) ELSE '' END AS images FROM f WHERE k NOT IN (3, 6)""")
def eml_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mails of many kinds, written and read back: missing and wrongly read headers, plain text, images of parts and of data URIs, lost and empty mails left out."""
    with scratch(spark) as folder:
        write_forms(_forms(spark, sf_dir), folder)
        one = F.array_join(F.transform("images", lambda i: F.concat_ws(" ", i["source"], F.coalesce(i["content_id"], F.lit("-")), F.md5(i["bytes"]))), ",")
        return cut(read_mails(spark, folder).select("file", "subject", "sender", *_body(), one.alias("images")))


@query("SELECT page_id || '.eml' AS file, 'LookupError: unknown encoding: no-such-charset' AS error FROM pages WHERE page_id % 8 = 3")
def eml_quarantine(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch(spark) as folder:
        write_forms(_forms(spark, sf_dir), folder)
        return cut(read_mails(spark, folder, keep_errors=True).where("error is not null").select("file", "error"))


@query("SELECT page_id, url, length(html) AS n, md5(html) AS md5, page_id % 3 AS flag, 2 * page_id + 5e-1 AS score FROM pages")
def report_array_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report of all mails as one JSON array, in a file in the shared folder, and its rows read back."""
    mails = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("subject"), F.lit(None).cast("string").alias("sender"), "html")
    analysis = mails.select("page_id", F.array((F.col("page_id") % 3).alias("f")).alias("flags"), (2 * F.col("page_id") + 0.5).alias("global_ai_score"), "html")
    entries = report_entries(mails, analysis, "page_id")
    with scratch(spark) as folder:
        n = write_full_report(entries, f"{folder}/report.json", "page_id")
        back = load_full_report(spark, f"{folder}/report.json", entries.schema) if n else entries
        return cut(back.select("page_id", F.col("email.subject").alias("url"), F.char_length("analysis.html").alias("n"), F.md5("analysis.html").alias("md5"), F.col("analysis.flags")[0].alias("flag"), F.col("analysis.global_ai_score").alias("score")))


@query("SELECT conv_id, turn, role, md5(text) AS md5 FROM conversations")
def json_save_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved as cleaned JSON lines into the shared folder and loaded again, bytes that aren't UTF-8 gone."""
    t = table(spark, sf_dir, "conversations")
    broken = F.concat(F.col("text").cast("binary"), F.lit(bytearray(b"\xff\xc3"))).cast("string")
    value = F.struct(F.array(broken).alias("texts"), F.create_map("role", F.struct("turn")).alias("turns"))
    with scratch(spark) as folder:
        save_json(t.select("conv_id", value.alias("v")), f"{folder}/j")
        back = load_json(spark, f"{folder}/j", "conv_id bigint, v struct<texts: array<string>, turns: map<string, struct<turn: bigint>>>")
        role = F.map_keys("v.turns")[0]
        return cut(back.select("conv_id", F.map_values("v.turns")[0]["turn"].alias("turn"), role.alias("role"), F.md5(F.col("v.texts")[0]).alias("md5")))


# --- recorded answers of a service

_SERVED = (
    ("concat('Sure: {\"ai_probability\": ', cast(doc_id % 101 as string), ', \"flags\": [\"A\"], \"summary\": \"s\"} done')", None),
    (None, "'HTTP 503'"),
    (None, "'Ошибка парсинга'"),
    ("'no object here'", None),
    (None, "'timed out'"),
    ("concat('{\"ai_probability\": ', cast(doc_id as string))", None),
)
_served = lambda k: "CASE doc_id % 6 " + " ".join(f"WHEN {i} THEN {a[k]}" for i, a in enumerate(_SERVED) if a[k]) + " END"


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interpret(table(spark, sf_dir, "documents").select("doc_id", "source", F.expr(_served(0)).alias("reply"), F.expr(_served(1)).alias("wrong")))


@query("""SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN (doc_id % 101)::VARCHAR ELSE '0' END AS ai_probability, CASE doc_id % 6 WHEN 0 THEN 'A' ELSE '' END AS flags,
  CASE doc_id % 6 WHEN 0 THEN 's' WHEN 1 THEN 'HTTP 503' WHEN 4 THEN 'timed out' ELSE 'Ошибка парсинга' END AS summary,
  CASE doc_id % 6 WHEN 1 THEN 'HTTP 503' WHEN 2 THEN 'Ошибка парсинга' WHEN 4 THEN 'timed out' ELSE 'ok' END AS status FROM documents""")
def recorded_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recorded(spark, sf_dir).select("doc_id", "ai_probability", F.array_join("flags", ",").alias("flags"), "summary", "status")


@query("SELECT source, count(*) AS n, sum(CASE WHEN doc_id % 6 = 0 THEN doc_id % 101 ELSE 0 END)::DOUBLE / count(*) AS mean FROM documents GROUP BY source")
def failures_stay_in_the_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _recorded(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("n"), (F.sum(F.col("ai_probability").cast("long")).cast("double") / F.count(F.lit(1))).alias("mean"))
