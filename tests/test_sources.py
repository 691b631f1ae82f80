import io
import zipfile

import pytest
from pyspark.sql import functions as F

from conftest import rows
from loomwright.sources import files, html, provider, store
from loomwright.schemas import DOCUMENTS

LIST = """<html><script>var currentPage = Number("0"), countPage = Number('3');</script><ul>
<li><a href="/a/1.html?utm_source=x">关于开展储能试点工作的通知</a><span>2026-03-05</span>
<li><a title="关于开展储能试点工作的公告 [2026-03-04]" href="2.html">短</a> [2026-03-04]</li>
<li><a href="/a/1.html">关于开展储能试点工作的通知（更正）</a> 2026年2月30日</li>
<li><a href="/x">没有日期的条目不会被收录</a></li><li><a href="javascript:go()">无效链接的条目不会被收录</a>2026-01-01</li></ul></html>"""

PAGE = """<html><head><meta name="PubDate" content="2026-03-09"><meta name="ArticleTitle" content=""></head><body>
<h1>某市能源局关于印发《办法》的通知</h1><table><tr><th>成文日期：</th><td>2026-03-01</td><td>发布时间</td><td>2026-03-02</td></tr></table>
<div id=zoom><p>能规〔2026〕12号<p>第一段&nbsp;&amp; 正文<br>第二行，本办法自印发之日起施行。<script>var x = "<p>no";</script>
<table><tr><td>1</td><td>2</td></tr></table><p style="text-align:right">某市能源局</p><p align="right">2026年3月1日</p>
<div class="fjlis">附件<a href="f/1.pdf">附件1.pdf</a></div><a href="/d?id=3" download="表.xlsx">下载</a><a href="/e" appendix="true">其他</a><a href="/page.html">链接</a><img src="fig.png"></div></body></html>"""


def test_lists(spark):
    other = "<li><a href='/1'>一个足够长的条目标题啊</a>2026-1-2</li><a href='p2.html'> 下一页</a>"
    df = spark.createDataFrame([("https://s.example/a/index.html", LIST), ("https://s.example/b", "<html>blocked</html>"), ("https://s.example/l/", other)], "url string, html string")
    out = rows(html.read_lists(df).select("page_url", "position", "url", "title", "list_date", "next_url", "error"))
    assert [r[:6] for r in out if r[2]] == [
        ("https://s.example/a/index.html", 1, "https://s.example/a/1.html", "关于开展储能试点工作的通知（更正）", None, "https://s.example/a/index_1.html"),
        ("https://s.example/a/index.html", 2, "https://s.example/a/2.html", "关于开展储能试点工作的公告", "2026-03-04", "https://s.example/a/index_1.html"),
        ("https://s.example/l/", 1, "https://s.example/1", "一个足够长的条目标题啊", "2026-01-02", "https://s.example/l/p2.html"),
    ]
    assert [r[0] for r in out if r[6] and "no dated entries" in r[6]] == ["https://s.example/b"]


def test_articles(spark):
    r = html.article(PAGE, "https://s.example/a/1.html")
    assert (r["title"], r["doc_number"], r["issuer"], r["publish_date"], r["written_date"]) == ("某市能源局关于印发《办法》的通知", "能规〔2026〕12号", "某市能源局", "2026-03-02", "2026-03-01")
    assert r["content_text"].split("\n")[:4] == ["能规〔2026〕12号", "第一段 & 正文", "第二行，本办法自印发之日起施行。", "1 2"] and "附件" not in r["content_text"]
    # the meta date counts only without a written date
    assert html.article('<meta name="PubDate" content="2026-03-09"><div id="zoom">' + "字" * 40 + "</div>", "https://s.example/", "题")["publish_date"] == "2026-03-09"
    inner = '<script>window.c = {question_data: {"article": {"title": "征求意见", "published_at": "2026-05-06 10:00", "content": "<p>' + "内容" * 30 + '</p>"}}}</script>'
    numbered = '<h1>国家能源局公告 2026年第3号</h1><div id="zoom">' + "字" * 40 + "</div>"
    pages = {"a/1.html": PAGE, "image": '<div id="zoom"><img src="a.jpg"></div>', "none": "<p>no body</p>", "empty": '<div id="zoom"> </div>', "null": "", "inner": inner, "n": numbered}
    df = spark.createDataFrame([(f"https://s.example/{k}", v) for k, v in pages.items()], "url string, html string")
    out = {k.rsplit("/", 1)[1]: r for k, r in ((r["url"], r) for r in html.read_articles(df).collect())}
    assert [(a["url"], a["format"], a["kind"]) for a in out["1.html"]["attachments"]] == [
        ("https://s.example/a/f/1.pdf", "pdf", "attachment"), ("https://s.example/d?id=3", "xlsx", "attachment"), ("https://s.example/e", "unknown", "attachment"), ("https://s.example/a/fig.png", "png", "inline_image"),
    ]
    assert {k: r["content_status"] for k, r in out.items()} == {"1.html": "partial", "image": "image_only", "none": "failed", "empty": "failed", "null": "failed", "inner": "complete", "n": "complete"}
    assert all("body" in out[k]["error"] for k in ("none", "empty", "null")) and (out["inner"]["title"], out["inner"]["publish_date"]) == ("征求意见", "2026-05-06")
    # number and issuer of the title, where the body has none
    assert (out["n"]["doc_number"], out["n"]["issuer"]) == ("国家能源局公告 2026年第3号", "国家能源局")
    assert html.data_url('<div id="showData0" data="x:' + "a" * 32 + '">', "https://s.example/l/") == "https://s.example/l/ds_" + "a" * 32 + ".json" and html.data_url("<p>", "https://s.example/") is None


def test_pages_in_bulk(spark):
    df = spark.createDataFrame([("https://s.example/a/1.html", PAGE, 1), ("https://s.example/b", "<p>", 2), ("https://s.example/c", None, 3)], "url string, html string, title int")
    out = {r["url"]: r for r in html.read_articles(df).collect()}
    assert out["https://s.example/a/1.html"]["error"] is None and out["https://s.example/b"]["content_status"] == "failed" and out["https://s.example/c"]["error"]
    lists = spark.createDataFrame([("https://s.example/a/index.html", LIST), ("https://s.example/b", None)], "url string, html string")
    assert [(r[0], r[1]) for r in rows(html.read_lists(lists).select("page_url", "position"))] == [("https://s.example/a/index.html", 1), ("https://s.example/a/index.html", 2), ("https://s.example/b", 0)]


def archive(members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in members.items():
            z.writestr(name, text)
    return out.getvalue()


W = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
M = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
DOCX = archive({"word/document.xml": f"<w:document {W}><w:body><w:p><w:r><w:t>第一段</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>甲</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>乙</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>"})
XLSX = archive(
    {
        "xl/workbook.xml": f'<workbook {M}><sheets><sheet name="汇总" sheetId="1" r:id="rId1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="rId1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {M}><si><t>名称</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {M}><sheetData><row><c t="s"><v>0</v></c><c><v>5</v></c><c><f>A1+1</f><v>6</v></c></row><row><c t="inlineStr"><is><t>行</t></is></c></row></sheetData></worksheet>',
    }
)


def test_files(spark, tmp_path):
    found = {"a.docx": DOCX, "b.xlsx": XLSX, "c.pdf": b"%PDF-1.4", "d.doc": b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1", "e.pdf": b" <!DOCTYPE html><p>", "f.zip": archive({"x": "y"}), "g.docx": b"PK\x03\x04broken", "h.png": b"\x89PNG.."}
    for name, data in found.items():
        (tmp_path / name).write_bytes(data)
    out = {r["path"].rsplit("/", 1)[1]: r for r in files.read_files(spark.read.format("binaryFile").load(str(tmp_path))).collect()}
    assert out["a.docx"]["text"] == "第一段\n甲\t乙" and out["b.xlsx"]["text"] == "[工作表：汇总]\n名称\t5\t=A1+1\n行"
    assert [out[n]["detected"] for n in sorted(found)] == ["zip", "zip", "pdf", "ole", "html", "zip", "zip", "png"]
    assert [out[n]["status"] for n in ("a.docx", "c.pdf", "e.pdf", "f.zip", "g.docx")] == ["parsed", "needs_manual_review", "needs_manual_review", "needs_manual_review", "failed"]
    assert out["d.doc"]["error"] == "legacy_or_encrypted_ole_container" and out["c.pdf"]["error"] == "no_extractable_text"
    assert out["e.pdf"]["error"] == "attachment_link_returns_html"


def pdf(*pages: tuple[str, bool]) -> bytes:
    """A small PDF: Latin text in literal strings, or Chinese in hexadecimal ones under a ToUnicode map; streams are compressed."""
    import zlib

    out = {1: b"<< /Type /Catalog /Pages 2 0 R >>"}
    kids, n = [], 10
    for text, mapped in pages:
        codes = {c: i for i, c in enumerate(dict.fromkeys(text), 1)}
        shown = b"<" + b"".join(b"%04X" % codes[c] for c in text) + b">" if mapped else b"(" + text.replace("(", "\\(").encode("latin-1") + b")"
        cmap = b"beginbfchar\n" + b"\n".join(b"<%04X> <%s>" % (i, c.encode("utf-16-be").hex().encode()) for c, i in codes.items()) + b"\nendbfchar"
        parts = zlib.compress(b"BT /F1 12 Tf 72 700 Td " + (shown + b" Tj T* [(x) -20 (y)] TJ ET" if not mapped else b"[" + shown + b"] TJ ET"))
        packed = zlib.compress(cmap)
        out[n] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R /Resources << /Font << /F1 %d 0 R >> >> >>" % (n + 1, n + 2)
        out[n + 1] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(parts), parts)
        out[n + 2] = b"<< /Type /Font" + (b" /ToUnicode %d 0 R" % (n + 3) if mapped else b"") + b" >>"
        out[n + 3] = b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(packed), packed)
        kids.append(b"%d 0 R" % n)
        n += 4
    out[2] = b"<< /Type /Pages /Kids [" + b" ".join(kids) + b"] /Count %d >>" % len(pages)
    return b"%PDF-1.5\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % item for item in sorted(out.items()))


def test_pdf_files():
    assert files.file_text(pdf(("Hello (world", False), ("储能电站管理办法", True)), "pdf") == ("parsed", "[第 1 页]\nHello (world\nxy\n[第 2 页]\n储能电站管理办法", None)
    assert files.file_text(b"%PDF-1.4", "pdf") == ("needs_manual_review", "", "no_extractable_text")
    assert files.file_text(pdf(("a", False)) + b"<< /Encrypt 9 0 R >>", "pdf")[0] == "failed"
    assert files.file_text(b"", "ole")[2] == "legacy_or_encrypted_ole_container"
    import time

    try:
        with files.limited(0.05):
            time.sleep(2)
    except TimeoutError:
        return
    raise AssertionError("no limit")


def test_discovery_resumes_and_ends(spark, tmp_path):
    from loomwright.sources import updates

    pages = {f"p{i}": ([{"url": f"u{i}{k}", "title": "t", "list_date": None if (i, k) == (0, 0) else f"2026-0{9 - i}-0{9 - k}"} for k in range(2)], f"p{i + 1}" if i < 4 else None) for i in range(5)}
    calls = []

    def read(at, broken=None):
        calls.append(at)
        if at == broken:
            raise OSError("down")
        return pages[at]

    path = f"file://{tmp_path}/c"
    with pytest.raises(OSError):
        updates.discover(updates.Checkpoint(spark, path, "a"), lambda at: read(at, "p2"), "p0", "2026-06-01")
    saved = updates.Checkpoint(spark, path, "a")
    assert saved.pages == ["p0", "p1"] and saved.upcoming == "p2"
    calls.clear()
    found = updates.discover(saved, read, "p0", "2026-06-01")
    assert calls == ["p2", "p3", "p4"] and [e["url"] for e in found] == ["u00", "u01", "u10", "u11", "u20", "u21", "u30", "u31"] and saved.ended == "before_since"
    assert updates.discover(updates.Checkpoint(spark, path, "a"), read, "p0", "2026-06-01") == found and calls == ["p2", "p3", "p4"]
    fresh = updates.Checkpoint(spark, path, "b")
    updates.discover(fresh, read, "p0", "2020-01-01", lambda u: u in ("u01", "u10", "u11"), 3)
    assert fresh.ended == "known_streak" and fresh.pages == ["p0", "p1"]
    last = updates.Checkpoint(spark, path, "c")
    updates.discover(last, read, "p0", "2020-01-01")
    assert last.ended == "end" and len(last.pages) == 5
    for bad in (lambda at: (pages["p0"][0], "p0"), lambda at: ([], None)):
        with pytest.raises(ValueError):
            updates.discover(updates.Checkpoint(spark, path, "d"), bad, "p0", "2020-01-01")


def test_series_and_gate(spark, tmp_path):
    from loomwright.sources import updates

    path = f"file://{tmp_path}/s"
    prices = lambda last: spark.sql(f"SELECT explode(sequence(date_sub(date'{last}', 300), date'{last}')) AS date").select("date", F.lit(5.0).alias("close"), F.lit("x").alias("open"))
    rules = {"least_points": 100, "first_within": 90}
    assert updates.update_series(spark, path, lambda: prices("2026-06-30"), "2026-07-01", **rules).count() == 301
    tries = []

    def failing(df):
        tries.append(1)
        return df

    for bad in (prices("2026-06-01"), prices("2026-06-30").withColumn("close", F.lit(-1.0)), prices("2026-06-30").drop("close")):
        tries.clear()
        with pytest.raises(RuntimeError, match="kept"):
            updates.update_series(spark, path, lambda bad=bad: failing(bad), "2026-07-01", **rules)
        assert len(tries) == 2 and store.read_snapshot(spark, path, "date date, close double").agg(F.max("date").cast("string")).first()[0] == "2026-06-30"
    log = []
    step = lambda name, value=None: lambda: log.append(name) or value
    updates.gated(step("c", "success"), step("r"), step("a", 0), step("p"), step("k"))
    for collect, failed in (("with_errors", 0), ("success", 2)):
        with pytest.raises(RuntimeError, match="kept"):
            updates.gated(step("c", collect), step("r"), step("a", failed), step("p"), step("k"))
    assert "".join(log) == "crapkckcrak"
    from loomwright.schemas import ANALYSES

    made = spark.createDataFrame([{"id": "1", "title": "题", "url": "u", "input_hash": "h", "relevance": "直接相关", "review_status": "待核查", "review_reasons": ["甲", "乙"]}], ANALYSES).withColumn("analysis_no", F.lit(1))
    now = spark.createDataFrame([("1", "h")], "id string, input_hash string")
    assert "## 题" in updates.sample_report(made, now, ["1"], ["# 样例"]) and "核查提示：甲；乙" in updates.sample_report(made, now, ["1"], [])
    with pytest.raises(ValueError, match="current input"):
        updates.sample_report(made, now.where("id = '2'"), ["1"], [])


def test_charsets(spark):
    bodies = [("储能".encode(), "text/html; charset=utf-8"), ("储能".encode("gb18030"), None), ("储能".encode("gb18030"), "text/html; charset=gb2312"), ("储能".encode("gb18030"), "text/html; charset=utf-8"), (b"\xff\xff\xff", None), (None, None), (b"", "charset=nonsense")]
    df = spark.createDataFrame([(i, b, c) for i, (b, c) in enumerate(bodies)], "i int, b binary, c string")
    assert [r[1] for r in rows(df.select("i", store.decoded(F.col("b"), F.col("c"))))] == ["储能", "储能", "储能", "储能", None, None, ""]


def test_document_store(spark, tmp_path):
    assert store.read_documents(spark, f"{tmp_path}/none", DOCUMENTS).count() == 0 and store.read_lines(spark, f"{tmp_path}/none", "a int").count() == 0
    (tmp_path / "p").mkdir()
    (tmp_path / "p/x.json").write_text('﻿{"id": "1", "title": "题",\n "attachments": [{"name": "a", "size_bytes": 3}]}', encoding="utf-8")
    (tmp_path / "p/y.json").write_text('{"id": "2", "unknown": true}')
    (tmp_path / "p/z.json").write_text("no json")
    out = {r["_stem"]: r for r in store.read_documents(spark, f"{tmp_path}/p", DOCUMENTS).collect()}
    assert out["x"]["title"] == "题" and out["x"]["attachments"][0]["size_bytes"] == 3 and out["y"]["title"] is None and out["z"]["_broken"]


def test_snapshots_and_logs(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    table = lambda: store.read_snapshot(spark, path, "id long")
    assert table().count() == 0
    for n in (3, 5):
        store.write_snapshot(spark.range(n), path)
        assert table().count() == n
    bad = spark.range(2).withColumn("x", F.raise_error(F.lit("broken")))
    with pytest.raises(Exception, match="broken"):
        store.write_snapshot(bad, path)
    assert table().count() == 5
    for n in (6, 7):
        store.write_snapshot(spark.range(n), path)
    assert table().count() == 7 and len([d for d in (tmp_path / "t").iterdir() if (d / "_SUCCESS").exists()]) == 2
    with store.RunLock(spark, path, "first"):
        with pytest.raises(RuntimeError, match="another run"), store.RunLock(spark, path):
            pass
    with store.RunLock(spark, path):
        pass
    for _ in range(2):
        store.append_lines(spark.range(2), f"{tmp_path}/log")
    assert store.read_lines(spark, f"{tmp_path}/log", "id long").count() == 4
    (tmp_path / "s.json").write_text('{"series": [{"date": "2026-01-01", "close": 1.5}, {"date": "2026-01-02", "close": null}]}')
    assert rows(store.series(spark, f"{tmp_path}/s.json", "date:string,close:double")) == [("2026-01-01", 1.5), ("2026-01-02", None)]
    base, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert rows(store.overlay(base, new, ["k"])) == [(1, "a"), (2, "c"), (3, "d")]


def test_json_lists(spark):
    body = '{"datasource": [{"showTitle": "<a href=\'/x\'>标题 &amp; 名</a>", "publishTime": "2026-01-02 03:04:05"}, {"title": "无链接"}, {"publishUrl": "/y", "title": "二"}, {"publishUrl": "javascript:x", "title": "三"}]}'
    df = spark.createDataFrame([("https://s.example/l/i.html", body), ("https://s.example/q", "broken"), ("https://s.example/r", None)], "page string, body string")
    assert [r[1:] for r in rows(store.json_list(df, "body", "page"))] == [("https://s.example/x", "标题 & 名", "2026-01-02", "2026-01-02 03:04:05"), ("https://s.example/y", "二", None, None)]


def test_provider_cache(spark):
    df = spark.createDataFrame([(1, "甲。乙", "c"), (2, "bad", "c"), (3, None, "c")], "id int, text string, answer string")

    def complete(text):
        if text == "bad":
            raise ValueError("refused")
        return provider.echo(text)

    first = provider.readings(df, "id", "text", complete)
    assert rows(first.select("id", "answer", "error")) == [(1, "甲", None), (2, None, "refused"), (3, "", None)]
    assert rows(provider.not_cached(df, "id", "text", first).select("id")) == [(2,)]
    changed = df.withColumn("text", F.when(F.col("id") == 1, "丙").otherwise(F.col("text")))
    assert rows(provider.not_cached(changed, "id", "text", first).select("id")) == [(1,), (2,)]
    failed = first.withColumn("answer", F.lit(None).cast("string")).withColumn("error", F.lit("later failure"))
    assert rows(provider.updated_cache(first, failed, "id").select("id", "answer", "error")) == [(1, "甲", None), (2, None, "later failure"), (3, "", None)]
