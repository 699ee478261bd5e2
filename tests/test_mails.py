"""Splitting, rules, aggregation, sources, sinks and streaming."""

import base64
import hashlib
import http.server
import json
import os
import re
import threading
from email.message import EmailMessage

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from quillon.functions.html import FLAGS, detect_flags, split_blocks
from quillon.functions.images import data_uri_images
from quillon.operators import mails as M
from quillon.plans.analyze import analyze_mails, process_directory
from quillon.sources import eml, providers, shared
from quillon.sources.sinks import load_full_report, load_json, mail_reports, report_entries, save_json, write_full_report, write_mail_reports
from quillon.sources.writer import to_eml
from quillon.streaming.mails import watch_folder

BODIES = [
    "<table><tr><td>a</td></tr></table> <TABLE x>b\nc</TABLE>",
    '<div class="content x">é</div><div class="my-content">n</div><div class=content>n</div><div class=" content">n</div>',
    "<div data-class=\"mainly\">y</div><div CLASS='Footer\">z</div>",
    "<ul>a<ol>b</ol>c</ul><ol>d</ol>",
    "<tablefoo>x</table><table>never closed",
    "<div class='section'><div>in</div>tail</div>",
    "<table>1<table>2</table>3</table>",
    "plain text",
    "",
    "<table><ul><li>x</li></ul></table>",
    "<ul>" + "x" * 26000 + "</ul>",
    None,
]
TAG = "<{0}[^>]*{1}>.*?</{0}>"
CLASS = """class=["'](?:main|header|content|section|footer)[^"']*["'][^>]*"""
PATTERNS = [
    ("table", "table", TAG.format("table", "")),
    ("div_section", "section", TAG.format("div", CLASS)),
    ("list", "list", TAG.format("ul", "") + "|" + TAG.format("ol", "")),
]


def plain_split(h):
    h = h or ""
    h = h[:25000] + "..." if len(h) > 25000 else h
    out = [(k, x, f"{p}_{i}") for k, p, r in PATTERNS for i, x in enumerate(re.findall(r, h, re.S | re.I))]
    return out or [("text_block", h, "full_text")]


def test_split(spark):
    df = spark.createDataFrame(list(enumerate(BODIES)), "i int, h string")
    for r in df.select("i", split_blocks(F.col("h")).alias("b")).collect():
        assert [tuple(x) for x in r.b] == plain_split(BODIES[r.i]), r.i


@pytest.mark.parametrize(
    "html, flags",
    [
        ("<table><tr><td>" * 6 + "x" + "</td></tr></table>" * 6, {"TOO_DEEP_NESTING"}),
        ("<table>" * 5 + "x" + "</table>" * 5, set()),
        ("<td> &nbsp;\n</td>", {"EMPTY_CELL"}),
        ('<p style="a:1">x</p>' * 3, {"DUPLICATE_STYLES"}),
        ("<!-- GENERATED by x -->", {"SUSPICIOUS_COMMENT"}),
        ("Dear {{ name }}", {"TEMPLATE_VARIABLE"}),
        ("<tr>a</tr>" * 3, {"REPETITIVE_PATTERN"}),
        ('<p style="a:1;b:2;c:3;d:4;">x</p>', {"INLINE_STYLE_OVERUSE"}),
        ('<a href="http://x.example/?q=1&redirect=y">', {"SUSPICIOUS_LINK"}),
        ("<img src=x><img alt=y>", {"MISSING_ALT"}),
        ("<div> <div><div>", {"STRUCTURAL_REDUNDANCY"}),
        ("plain", set()),
        ("", set()),
    ],
)
def test_rules(spark, html, flags):
    got = spark.createDataFrame([(html,)], "h string").select(detect_flags(F.col("h"))).first()[0]
    assert set(got) == flags and set(got) <= set(FLAGS)


def test_data_uris(spark):
    ok, text = base64.b64encode(b"0123").decode(), '<img src="data:image/png;base64,{}"> DATA:image/x;base64,AAA '
    h = text.format(ok[:4] + "\n " + ok[4:])
    got = spark.createDataFrame([(h,)], "h string").select(data_uri_images(F.col("h"))).first()[0]
    assert [bytes(x) for x in got] == [b"0123"]


def mail(subject="s", html="<p>hello there world</p>", plain=None, image=None):
    m = EmailMessage()
    m["Subject"], m["From"] = subject, "a@b.example"
    if plain is not None:
        m.set_content(plain)
        if html is not None:
            m.add_alternative(html, subtype="html")
    elif html is not None:
        m.set_content(html, subtype="html")
    if image:
        m.add_attachment(image, maintype="image", subtype="png", filename="p.png")
    return m.as_bytes()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("in")
    files = {
        "a.eml": mail("Тема", html='<table><tr><td>&nbsp;</td><td>{{x}}</td></tr></table><img src="data:image/gif;base64,QUJDRA==">'),
        "b.eml": mail(html=None, plain="the plain body of it"),
        "c.eml": mail(html="x"),
        "d.eml": mail(html="x", image=b"PNGDATA"),
        "e.eml": b"From: q\r\n\r\nno content type here at all",
        "f.eml": b"Subject: \xc3\x90\xc2\x9f\r\nContent-Type: text/html\r\n\r\n<p>latin one twice read</p>",
        "g.txt": mail(),
    }
    for n, c in files.items():
        (d / n).write_bytes(c)
    (d / "sub").mkdir()
    (d / "sub" / "h.eml").write_bytes(mail())
    return d


def test_read_mails(spark, folder):
    got = {r.file: r for r in eml.read_mails(spark, str(folder), partitions=3).collect()}
    assert set(got) == {"a.eml", "b.eml", "d.eml", "e.eml", "f.eml"}
    assert got["a.eml"].subject == "Тема" and [(i.source, bytes(i.bytes)) for i in got["a.eml"].images] == [("data_uri_0", b"ABCD")]
    assert got["b.eml"].html.strip() == "the plain body of it"
    assert got["d.eml"].html == "" and [(i.source, bytes(i.bytes), i.content_id) for i in got["d.eml"].images] == [("p.png", b"PNGDATA", None)]
    assert got["e.eml"].subject == eml.NO_SUBJECT and got["e.eml"].sender == "q"
    assert len(eml.read_mails(spark, str(folder), keep_errors=True).collect()) == 6


def test_headers():
    assert eml.repair("Ð\x9fÑ\x80") == "Пр" and eml.repair("Пр") == "Пр" and eml.repair("café") == "café"
    assert eml.parse_mail(to_eml("Тема", "x@y.example", "<p>ü</p>"))["html"].strip() == "<p>ü</p>"
    assert eml.parse_mail(b"")["subject"] == eml.NO_SUBJECT


def test_analysis_and_report(spark, folder, tmp_path):
    report = tmp_path / "full.json"
    n = process_directory(spark, str(folder), str(report), reader=lambda b: "text of " + b.decode(), ocr_provider=lambda d: providers.by_rules(d, F.lit(90)))
    entries = json.loads(report.read_text())
    assert n == 5 and [e["file"] for e in entries] == ["a.eml", "b.eml", "d.eml", "e.eml", "f.eml"]
    a, d = entries[0]["analysis"], entries[2]["analysis"]
    assert entries[0]["email"] == {"subject": "Тема", "sender": "a@b.example"}
    assert a["global_flags"] == ["TEMPLATE_VARIABLE", "EMPTY_CELL"] and a["html_ai_score"] == 30.0
    assert a["ocr"] == {"images_count": 1, "text": [{"source": "data_uri_0", "text": "text of ABCD", "has_text": True}], "summary": "", "flags": [], "ai_score": 90.0}
    assert a["global_ai_score"] == 60.0 and a["engine"]["signals"]["html_weight"] == 0.5
    assert d["blocks"][0]["position"] == "full_text" and d["engine"]["signals"]["ocr_weight"] == 0.7 and d["global_ai_score"] == 63.0
    assert entries[1]["analysis"]["ocr"]["images_count"] == 0 and entries[1]["analysis"]["global_ai_score"] == 0.0
    none = tmp_path / "none"
    none.mkdir()
    assert process_directory(spark, str(none), str(tmp_path / "no.json")) == 0 and not (tmp_path / "no.json").exists()


def test_mail_reports(spark, folder, tmp_path):
    mails = eml.read_mails(spark, str(folder))
    write_mail_reports(mail_reports(mails, analyze_mails(mails)), str(tmp_path / "out"))
    back = {r.file: r for r in spark.read.json(str(tmp_path / "out")).collect()}
    assert len(back) == 5 and re.fullmatch(r"\d{8}_\d{6}", back["a.eml"].timestamp)
    assert back["a.eml"].analysis.blocks_summary[0].position == "table_0"


def test_failed_blocks_stay_in_the_mean(spark):
    rows = [("m", i, "table", f"table_{i}", p, [], "") for i, p in enumerate(["100", "0", None])]
    df = spark.createDataFrame(rows, "file string, block_idx int, type string, position string, ai_probability string, flags array<string>, summary string")
    r = M.aggregate_mails(M.score_blocks(df)).first()
    assert r.html_ai_score == 11.7 and [b.block_idx for b in r.blocks] == [0, 1, 2] and r.high_risk_blocks == []


def test_golden_sample(spark):
    """Means, flags and risks of the surveyed sample's kind: first-seen order, scores of 70 and more."""
    p = [25, 75, 15, 85]
    rows = [("x", i, "table", f"table_{i}", str(v), f, "") for i, (v, f) in enumerate(zip(p, [["EMPTY_CELL"], ["b", "EMPTY_CELL"], [], ["c", "b"]], strict=True))]
    df = spark.createDataFrame(rows, "file string, block_idx int, type string, position string, ai_probability string, flags array<string>, summary string")
    assert M.legacy_global_score(df.withColumn("p", F.col("ai_probability").cast("int"))).first().global_ai_score == 50
    assert M.aggregate_mails(M.score_blocks(df)).first().global_flags == ["EMPTY_CELL", "b", "c"]


def test_lookup_and_ocr_text(spark):
    b = spark.createDataFrame([("f", "one"), ("f", "two"), ("f", "one")], "file string, content string")
    md5 = hashlib.md5(b"one").hexdigest()
    replies = spark.createDataFrame([(md5, "70", ["X"], "s")] * 2, "md5 string, ai_probability string, flags array<string>, summary string")
    assert sorted((r.content, r.ai_probability, r.summary) for r in providers.by_lookup(b, replies).collect()) == [("one", "70", "s")] * 2 + [("two", "0", "")]
    res = spark.createDataFrame([([("a", " x "), (None, "y"), ("c", " "), ("d", None)],), ([],), ([("e", "z" * 20000)],)], "r array<struct<source:string,text:string>>")
    got = [r[0] for r in res.select(M.ocr_text(F.col("r"))).collect()]
    assert got[:2] == ["IMAGE: a\nx\n\nIMAGE: unknown\ny", ""] and len(got[2]) == 10003


class Stub(http.server.BaseHTTPRequestHandler):
    def do_POST(self):
        body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
        text = body["messages"][1]["content"].rsplit("\n\n", 1)[1]
        code = 500 if text == "bad" else 200
        answer = {} if text == "none" else {"choices": [{"message": {"content": 'ok {"ai_probability": 42, "flags": ["F"], "summary": "%s"}' % self.headers["Authorization"]}}]}
        self.send_response(code)
        self.end_headers()
        self.wfile.write(json.dumps(answer).encode())

    def log_message(self, *_):
        pass


def test_service(spark):
    server = http.server.HTTPServer(("127.0.0.1", 0), Stub)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        df = spark.createDataFrame([("good",), ("good",), ("bad",), ("none",), (None,)], "content string")
        s = providers.Service(f"http://127.0.0.1:{server.server_port}/", "k", "m", pause=0)
        got = {r.content: r for r in providers.by_service(df, s).collect()}
    finally:
        server.shutdown()
    assert set(got) == {"good", "bad", "none"}
    assert (got["good"].ai_probability, got["good"].flags, got["good"].summary, got["good"].status) == ("42", ["F"], "Bearer k", "ok")
    assert (got["bad"].ai_probability, got["bad"].summary) == ("0", "HTTP 500") and got["none"].summary == providers.PARSE_ERROR


def test_stream(spark, folder, tmp_path):
    q = watch_folder(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5
    q = watch_folder(spark, str(folder), str(tmp_path / "out"), str(tmp_path / "cp"), once=True)
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_json_is_cleaned_saved_and_loaded(spark, tmp_path):
    kind = "struct<s: string, l: array<struct<t: string, n: int>>, m: map<string, array<string>>>"
    raw = spark.createDataFrame([(1, b"a\xffb\xc3", "� ok"), (2, None, None)], "id int, b binary, t string")
    s = F.col("b").cast("string")
    value = F.struct(s.alias("s"), F.array(F.struct(s.alias("t"), F.lit(3).alias("n"))).alias("l"), F.create_map(F.coalesce(s, F.lit("k")), F.array("t", s)).alias("m"))
    df = raw.select("id", F.when(F.col("id") == 1, value).alias("v"))
    save_json(df, str(tmp_path / "lines"))
    one, none = load_json(spark, str(tmp_path / "lines"), f"id int, v {kind}").orderBy("id").collect()
    assert one.v.asDict(True) == {"s": "ab", "l": [{"t": "ab", "n": 3}], "m": {"ab": ["� ok", "ab"]}} and none.v is None
    for text, n in (('[\n  {"a": 1},\n  {"a": 2}\n]', 2), ('{\n "a": 1\n}', 1), ('{"a": 1}\n{"a": 2}', 2), ("[]", 0)):
        (tmp_path / "x.json").write_text(text)
        assert load_json(spark, str(tmp_path / "x.json"), "a int").count() == n


def test_full_report_is_written_and_read_in_pieces(spark, tmp_path, monkeypatch):
    # what parts two entries, within strings
    odd = ["\n},\n{\n", "[\n{\n", "\n}\n]\n", '"\\', "\u2028\r\n\x00é😀", "", None, "},", "x" * 3000]
    rows = [(i, ("s", odd[i % len(odd)]), ([(odd[(i + 1) % len(odd)], i / 4)] * (i % 3), {"k": None})) for i in range(60)]
    kind = "file int, email struct<subject: string, sender: string>, analysis struct<blocks: array<struct<c: string, p: double>>, m: map<string, string>>"
    df = spark.createDataFrame(rows, kind).repartition(7)
    path = tmp_path / "a report.json"
    # neither text nor rows go through the driver
    monkeypatch.setattr(type(df), "toLocalIterator", None)
    monkeypatch.setattr(type(df), "collect", None)
    for n in (60, 1, 2):
        some = df.where(f"file < {n}")
        assert write_full_report(some, str(path)) == n and os.listdir(tmp_path) == [path.name]
        want = [{"file": i, "email": dict(zip(("subject", "sender"), e, strict=True)), "analysis": {"blocks": [{"c": c, "p": p} for c, p in a[0]], "m": a[1]}} for i, e, a in rows[:n]]
        assert path.read_text(newline="") == "[\n" + ",\n".join(json.dumps(w, indent=2, ensure_ascii=False) for w in want) + "\n]\n"
    assert write_full_report(df.where("file < 0"), str(path)) == 0 and len(json.loads(path.read_text())) == 2
    write_full_report(df, str(path))
    monkeypatch.undo()
    had = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (499, 4096, 1 << 20):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            back = load_full_report(spark, str(path), df.schema)
            assert back.rdd.getNumPartitions() == -(-path.stat().st_size // size)
            assert sorted(back.collect()) == sorted(df.collect())
        # a task begins at every byte
        few = df.where("file < 4")
        write_full_report(few, str(path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1")
        assert sorted(load_full_report(spark, str(path), df.schema).collect()) == sorted(few.collect())
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", had)


def test_report_entries_are_those_of_a_join_and_shuffle_texts_once(spark):
    mails = spark.createDataFrame([(1, "a", "b"), (2, None, None), (2, "c", "d"), (None, "e", "e"), (4, "z", "z")], "page_id bigint, subject string, sender string")
    analysis = spark.createDataFrame([(1, "a", [1]), (2, "x", [2]), (2, None, None), (None, "e", []), (5, "z", [])], "page_id bigint, html string, flags array<int>")
    entries = report_entries(mails, analysis, "page_id")
    want = [(1, ("a", "b"), ("a", [1]))] + [(2, e, a) for e in ((None, None), ("c", "d")) for a in (("x", [2]), (None, None))]
    assert sorted(map(str, entries.select("page_id", "email.*", "analysis.*").collect())) == sorted(str(Row("page_id", "subject", "sender", "html", "flags")(i, *e, *a)) for i, e, a in want)
    plan = entries.orderBy("page_id")._jdf.queryExecution().executedPlan().toString()
    # the other one has subjects and senders only
    assert plan.count("Exchange rangepartitioning") == 1 and plan.count("Exchange") == 2 and "Join" not in plan


def test_answers_that_went_wrong(spark):
    rows = [('x {"ai_probability": 7, "flags": "A", "summary": null}', None), ('{"ai_probability": 7}', "HTTP 500"), (None, None), ("", None), ("none", None)]
    got = providers.interpret(spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "i int, reply string, wrong string")).orderBy("i").collect()
    assert [r.ai_probability for r in got] == ["7", "0", "0", "0", "0"]
    assert [r.status for r in got] == ["ok", "HTTP 500", "ok", "ok", "ok"]
    assert [r.summary for r in got] == ["", "HTTP 500"] + [providers.PARSE_ERROR] * 3


def test_shared_folder_is_gone_and_needs_a_name_on_a_cluster(spark, monkeypatch):
    with shared.scratch(spark) as folder:
        kept = shared.cut(shared.stored(spark.range(9), folder).where("id > 3"))
    assert kept.count() == 5 and not os.path.exists(re.sub("^file:/*", "/", folder))

    class Elsewhere:
        master = "spark://there"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

    with pytest.raises(RuntimeError):
        shared.ensure_checkpoint_dir(type("Session", (), {"sparkContext": Elsewhere, "conf": type("C", (), {"get": lambda self, k, d: d})()})())
