"""Queries that read pages: stored records rendered as HTML and read back, and JSON round trips."""

from __future__ import annotations

from pyspark.sql import functions as F

from loomwright.operators import nested, readings
from loomwright.plans.records import _INDEX, _URL, _iso
from loomwright.schemas import ANALYSIS_INDEX, DOCUMENTS
from loomwright.session import materialise, scratch, table
from loomwright.sources import config, files, html, store


def _escaped(col):
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        col = F.replace(col, F.lit(char), F.lit(entity))
    return col


def _pages(spark, d):
    """Every record with a body, rendered as a page with furniture around it."""
    p = table(spark, d, "policies").where("length(trim(content_text)) > 0")
    paragraphs = F.array_join(F.transform(F.split("content_text", "\n"), lambda line: F.concat(F.lit("<p>"), _escaped(line))), "")
    links = F.coalesce(F.array_join(F.transform("attachments", lambda a: F.concat(F.lit("<a href='"), _escaped(a["url"]), F.lit("'>"), _escaped(F.coalesce(a["name"], F.lit(""))), F.lit("</a>"))), ""), F.lit(""))
    page = F.concat(
        F.lit('<html><head><meta name="ArticleTitle" content="'), _escaped(F.coalesce("title", F.lit(""))), F.lit('"><script>var a = "<p>";</script></head><body><ul><li>nav</ul><div id="zoom">'), paragraphs, F.lit('<div class="fjlis">'), links, F.lit("</div></div></body></html>")
    )
    return p.select("record_id", F.concat(F.lit("https://pages.example/"), F.col("record_id").cast("string")).alias("url"), page.alias("html"))


def html_articles(spark, d):
    read = html.read_articles(_pages(spark, d))
    return read.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("record_id"), "title", F.sha2("content_text", 256).alias("body"), "content_status", "body_selector", "error")


def html_lists(spark, d):
    """Each column's records as one list page, read back to entries."""
    title = _escaped(F.regexp_replace(F.coalesce("title", F.lit("")), "[^一-龥A-Za-z]", ""))
    p = table(spark, d, "policies").where("list_date IS NOT NULL AND url IS NOT NULL AND column_id IS NOT NULL")
    item = F.concat(F.lit("<li><a href='/r/"), F.col("record_id").cast("string"), F.lit("'>"), title, F.lit("</a><span>"), F.col("list_date"), F.lit("</span>"))
    # a page holds a bounded number of entries: fifty records of a column
    pages = p.groupBy("column_id", F.floor(F.col("record_id") / 50).alias("page")).agg(F.array_join(F.array_sort(F.collect_list(item)), "").alias("items"))
    rendered = pages.select(F.concat_ws("/", F.lit("https://lists.example"), "column_id", F.col("page").cast("string")).alias("url"), F.concat(F.lit("<html><ul>"), F.col("items"), F.lit("</ul></html>")).alias("html"))
    return html.read_lists(rendered).where("error IS NULL").select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("record_id"), "title", "list_date")


def json_store(spark, d):
    """Records written as JSON lines under the explicit schema and read back."""
    path = scratch(spark, "json")
    columns = [c.name for c in spark.createDataFrame([], DOCUMENTS).schema]
    store.append_lines(table(spark, d, "policies").select(*columns, "record_id"), path)
    read = store.read_lines(spark, path, f"{DOCUMENTS}, record_id bigint")
    return read.select("record_id", "id", "title", F.sha2(F.coalesce("content_text", F.lit("")), 256).alias("body"), F.coalesce(F.size("attachments"), F.lit(-1)).cast("long").alias("files"))


def json_list(spark, d):
    """Titles in markup inside a JSON list, read back."""
    p = table(spark, d, "policies").where("url IS NOT NULL")
    shown = F.concat(F.lit("<a href='"), F.col("url"), F.lit("'>"), _escaped(F.coalesce("title", F.lit(""))), F.lit("</a>"))
    body = F.to_json(F.struct(F.array(F.struct(shown.alias("showTitle"), F.coalesce("list_date", F.lit("")).alias("publishTime"))).alias("datasource")))
    pages = p.select(F.concat(F.lit("https://lists.example/"), F.col("record_id").cast("string")).alias("page"), body.alias("body"))
    return store.json_list(pages, "body", "page").select(F.regexp_extract("page", "([0-9]+)$", 1).cast("long").alias("record_id"), "link", "title", "list_date", F.col("list_date_raw").alias("listed"))


def html_attachments(spark, d):
    """Files linked from the rendered pages, each once by its canonical address."""
    read = html.read_articles(_pages(spark, d))
    shown = F.transform("attachments", lambda a: F.concat_ws(" ", a["format"], a["url"]))
    return read.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("record_id"), F.array_join(shown, "|").alias("files"), "content_status")


def embedded_articles(spark, d):
    """Records rendered as articles inside a script, read back."""
    p = table(spark, d, "policies").where("length(trim(content_text)) > 0")
    inner = F.to_json(F.struct(F.struct(F.coalesce("title", F.lit("")).alias("title"), F.lit("2026-05-06 10:00").alias("published_at"), F.concat(F.lit("<p>"), F.replace(_escaped(F.col("content_text")), F.lit("\n"), F.lit("</p><p>"))).alias("content")).alias("article")))
    page = F.concat(F.lit("<script>window.c = {question_data: "), inner, F.lit("};</script>"))
    read = html.read_articles(p.select(F.concat(F.lit("https://pages.example/"), F.col("record_id").cast("string")).alias("url"), page.alias("html")))
    return read.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("record_id"), "title", F.sha2("content_text", 256).alias("body"), "publish_date", "body_selector")


def page_fields(spark, d):
    """Dates from a table of labels, or from a signature at the right below the organisation's name."""
    p = table(spark, d, "policies").where("record_id IS NOT NULL")
    cell = lambda label, name: F.concat(F.lit(f"<tr><th>{label}：</th><td>"), _escaped(F.coalesce(name, F.lit(""))), F.lit("</td></tr>"))
    labels = F.concat(F.lit("<table>"), cell("成文日期", "written_date"), cell("发布日期", "publish_date"), F.lit("</table>"))
    signed = F.concat(F.lit('<p style="text-align:right">'), _escaped(F.coalesce("issuer", F.lit(""))), F.lit('</p><p align="right">2026年3月1日</p>'))
    body = F.lit("本办法自印发之日起施行，各单位应当按照职责分工抓好落实，重大事项及时报告。")
    page = F.concat(F.lit("<html><body><h1>关于某事</h1>"), F.when(F.col("record_id") % 2 == 0, labels).otherwise(""), F.lit('<div id="zoom"><p>'), body, F.lit("</p>"), F.when(F.col("record_id") % 2 == 1, signed).otherwise(""), F.lit("</div></body></html>"))
    read = html.read_articles(p.select(F.concat(F.lit("https://pages.example/"), F.col("record_id").cast("string")).alias("url"), page.alias("html")))
    return read.select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("record_id"), "publish_date", "written_date", "issuer")


def data_urls(spark, d):
    """Addresses of the JSON lists that pages name by an identifier."""
    p = table(spark, d, "policies")
    page = F.concat(F.lit('<div id="showData0" data="list:'), F.when(F.col("record_id") % 3 == 0, "none").otherwise(F.md5(F.col("record_id").cast("string"))), F.lit('"></div>'))
    return html.read_data_urls(p.select(F.concat(F.lit("https://pages.example/l/"), F.col("record_id").cast("string")).alias("url"), page.alias("html"))).select(F.regexp_extract("url", "([0-9]+)$", 1).cast("long").alias("record_id"), "data_url")


def attachment_metadata(spark, d):
    """Each record's attachments with the file a metadata object tells of, for records that have one."""
    p = table(spark, d, "policies")
    told = F.when(F.col("record_id") % 2 == 0, F.to_json(F.struct(F.lit("7").alias("id"), F.lit("说明.pdf").alias("name"), F.lit("/files/7.pdf").alias("path")))).when(F.col("record_id") % 5 == 0, F.lit("broken"))
    both = nested.with_metadata(F.col("attachments"), told, "https://files.example")
    return p.select("record_id", F.array_join(F.transform(both, lambda a: a["url"]), "|").alias("urls"))


def _zip(members: dict[str, str]) -> bytes:
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, text in members.items():
            archive.writestr(name, text)
    return out.getvalue()


def _rendered(spark, d, render):
    """(path, content): every record's body as a file made by ``render``."""
    @F.pandas_udf("binary")
    def made(titles, bodies):
        import pandas as pd

        return pd.Series([render(t or "", b or "") for t, b in zip(titles, bodies)])

    return table(spark, d, "policies").select(F.col("record_id").cast("string").alias("path"), made("title", "content_text").alias("content"))


def _read(found):
    return found.select(F.col("path").cast("long").alias("record_id"), "detected", "status", F.sha2("text", 256).alias("text"))


def docx_files(spark, d):
    """Bodies written as word-processor files, a paragraph a line, and read back."""
    from xml.sax.saxutils import escape

    def render(title, body):
        fit = lambda x: escape("".join(c for c in x if c >= " " or c == "\t"))
        lines = "".join(f'<w:p><w:r><w:t xml:space="preserve">{fit(line)}</w:t></w:r></w:p>' for line in body.split("\n"))
        return _zip({"word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{lines}</w:body></w:document>'})

    return _read(files.read_files(_rendered(spark, d, render)))


def xlsx_files(spark, d):
    """Titles in a sheet, a cell beside a formula, read back."""
    from xml.sax.saxutils import escape

    def render(title, body):
        space = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
        cell = f'<c t="inlineStr"><is><t>{escape("".join(c for c in title if c >= " "))}</t></is></c>'
        return _zip({
            "xl/workbook.xml": f'<workbook xmlns="{space}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="表" sheetId="1" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{space}"><sheetData><row>{cell}<c><f>A1+1</f></c></row></sheetData></worksheet>',
        })

    return _read(files.read_files(_rendered(spark, d, render)))


def pdf_files(spark, d):
    """Titles in compressed PDF pages under a font's character map, read back; records without a title have no text."""
    def render(title, body):
        import zlib

        text = " ".join(title.split())
        codes = {c: i for i, c in enumerate(dict.fromkeys(text), 256)}
        pack = lambda raw: b"<< /Length %d /Filter /FlateDecode >>\nstream\n%s\nendstream" % (len(z := zlib.compress(raw)), z)
        shown = b"BT /F1 9 Tf 72 700 Td <" + b"".join(b"%04X" % codes[c] for c in text) + b"> Tj ET"
        cmap = b"beginbfchar\n" + b"\n".join(b"<%04X> <%s>" % (i, c.encode("utf-16-be").hex().encode()) for c, i in codes.items()) + b"\nendbfchar"
        parts = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", b"<< /Type /Page /Parent 2 0 R /Contents 4 0 R /Resources << /Font << /F1 5 0 R >> >> >>", pack(shown), b"<< /Type /Font /ToUnicode 6 0 R >>", pack(cmap)]
        return b"%PDF-1.5\n" + b"\n".join(b"%d 0 obj\n%s\nendobj" % (i, x) for i, x in enumerate(parts, 1))

    return _read(files.read_files(_rendered(spark, d, render)))


def series_files(spark, d):
    """Daily maxima written as one curated series file and read back, a missing file beside it as an empty table."""
    path = scratch(spark, "series")
    daily = table(spark, d, "orders").groupBy(F.date_format("o_orderdate", "yyyy-MM-dd").alias("date")).agg(F.max("o_totalprice").alias("close"))
    # one point a day: the file is as long as the series
    whole = daily.agg(F.array_sort(F.collect_list(F.struct("date", "close"))).alias("series"))
    whole.coalesce(1).write.json(path)
    return store.series(spark, path, "date:string,close:double").unionByName(store.series(spark, f"{path}-missing", "date:string,close:double"))


def enabled_columns(spark, d):
    """Configured columns that are on and selected."""
    found = table(spark, d, "column_health").select("column_id", "name", (F.col("status") != "degraded").alias("enabled")).collect()  # the configuration: about forty columns
    chosen = ",".join(sorted(r["column_id"] for r in found if r["column_id"] < "m"))
    return config.enabled_columns(spark, [r.asDict() for r in found], chosen).select("column_id", "name")


def published_index(spark, d):
    """Index, groups and summary of readings, published from one computation and read back."""
    from loomwright.plans.records import _index

    path, index = scratch(spark, "index"), materialise(_index(spark, d), "index")
    store.write_snapshot(index.select("id", "canonical_id", "keywords", "relevance", "status", "visible"), f"{path}/index")
    store.write_snapshot(readings.index_summary(index), f"{path}/summary")
    total = store.read_snapshot(spark, f"{path}/summary", "total bigint, raw_total bigint, merged_records bigint, keyword_matches bigint")
    shown = store.read_snapshot(spark, f"{path}/index", ANALYSIS_INDEX)
    return shown.crossJoin(F.broadcast(total.select("total"))).select("id", "canonical_id", F.array_join("keywords", "|").alias("keywords"), "relevance", "status", "visible", "total")


QUERIES = {f.__name__: f for f in (
    html_articles, html_lists, json_store, json_list, html_attachments, embedded_articles, page_fields, data_urls, attachment_metadata, docx_files, xlsx_files, pdf_files, series_files, enabled_columns, published_index,
)}

_SP = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]"
_TEXT = rf"""
        t AS (SELECT record_id, title, array_to_string(list_filter(list_transform(
            string_split_regex(content_text, '[\n\r\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]'), lambda l: trim(regexp_replace(l, '{_SP}+', ' ', 'g'))), lambda l: l <> ''), chr(10)) AS body
        FROM policies WHERE length(trim(content_text)) > 0)"""
_TITLE = f"trim(regexp_replace(coalesce(title, ''), '{_SP}+', ' ', 'g'))"
_STATUS = "CASE WHEN length(body) < 30 THEN 'partial' ELSE 'complete' END"
_KINDS = "[" + ", ".join(f"'{k}'" for k in sorted(html.FILE_TYPES)) + "]"
_ORG = "[^，。；：:《》\\s]{2,65}(?:局|厅|委员会|委|部|办公室|分行|人民政府|司|中心)"
SQL = {
    "html_articles": f"WITH {_TEXT} SELECT record_id, {_TITLE} AS title, sha256(body) AS body, {_STATUS} AS content_status, 'zoom' AS body_selector, NULL::VARCHAR AS error FROM t",
    "html_attachments": rf"""
        WITH {_TEXT}, a AS (SELECT record_id, unnest(attachments) AS a, unnest(range(1, len(attachments) + 1)) AS i FROM policies),
        k AS (SELECT record_id, i, a.url, coalesce(CASE WHEN list_contains({_KINDS}, e) THEN e END, CASE WHEN list_contains({_KINDS}, f) THEN f END) AS form
              FROM (SELECT *, lower(regexp_extract(a.url, '\.([^./?#]+)$', 1)) AS e, lower(regexp_extract(a.name, '\.([^./?#]+)$', 1)) AS f FROM a)),
        l AS (SELECT record_id, url, min(i) AS pos, arg_max(form, i) AS form FROM k WHERE form IS NOT NULL AND url IS NOT NULL GROUP BY 1, 2)
        SELECT t.record_id, coalesce(string_agg(form || ' ' || url, '|' ORDER BY pos), '') AS files, any_value({_STATUS}) AS content_status FROM t LEFT JOIN l USING (record_id) GROUP BY 1""",
    "embedded_articles": f"WITH {_TEXT} SELECT record_id, {_TITLE} AS title, sha256(body) AS body, '2026-05-06' AS publish_date, 'embedded article' AS body_selector FROM t",
    "page_fields": f"""
        WITH s AS (SELECT record_id, record_id % 2 = 1 AS signed, {_iso('publish_date')} AS p, {_iso('written_date')} AS w, trim(regexp_replace(coalesce(issuer, ''), '{_SP}+', ' ', 'g')) AS i FROM policies)
        SELECT record_id, CASE WHEN NOT signed THEN p END AS publish_date, CASE WHEN NOT signed THEN w WHEN regexp_full_match(i, '{_ORG}') THEN '2026-03-01' END AS written_date,
            CASE WHEN signed AND regexp_full_match(i, '{_ORG}') THEN i END AS issuer FROM s""",
    "data_urls": "SELECT record_id, CASE WHEN record_id % 3 <> 0 THEN 'https://pages.example/l/ds_' || md5(record_id::VARCHAR) || '.json' END AS data_url FROM policies",
    "attachment_metadata": """
        SELECT record_id, CASE WHEN attachments IS NULL AND record_id % 2 <> 0 THEN NULL ELSE array_to_string(list_concat(coalesce(list_transform(attachments, lambda a: a.url), []), CASE WHEN record_id % 2 = 0 THEN ['https://files.example/files/7.pdf'] ELSE [] END), '|') END AS urls FROM policies""",
    "docx_files": r"""
        WITH t AS (SELECT record_id, coalesce(array_to_string(list_filter(list_transform(string_split(content_text, chr(10)), lambda l: regexp_replace(l, '[\x01-\x08\x0b-\x1f]', '', 'g')), lambda l: regexp_matches(l, '[^\s\x1c-\x1f\x{85}\p{Z}]')), chr(10)), '') AS t FROM policies)
        SELECT record_id, 'zip' AS detected, CASE WHEN t = '' THEN 'needs_manual_review' ELSE 'parsed' END AS status, sha256(t) AS text FROM t""",
    "xlsx_files": r"""
        SELECT record_id, 'zip' AS detected, 'parsed' AS status, sha256('[工作表：表]' || chr(10) || regexp_replace(coalesce(title, ''), '[\x01-\x1f]', '', 'g') || chr(9) || '=A1+1') AS text FROM policies""",
    "pdf_files": f"""
        WITH t AS (SELECT record_id, {_TITLE} AS t FROM policies)
        SELECT record_id, 'pdf' AS detected, CASE WHEN t = '' THEN 'needs_manual_review' ELSE 'parsed' END AS status, sha256(CASE WHEN t = '' THEN '' ELSE '[第 1 页]' || chr(10) || t END) AS text FROM t""",
    "series_files": "SELECT strftime(o_orderdate, '%Y-%m-%d') AS date, max(o_totalprice) AS close FROM orders GROUP BY 1",
    "enabled_columns": "SELECT column_id, name FROM column_health WHERE status <> 'degraded' AND column_id < 'm'",
    "published_index": f"WITH {_INDEX} SELECT id, canonical_id, array_to_string(keys, '|') AS keywords, relevance, status, visible, (SELECT count(*) FILTER (id = canonical_id) FROM i) AS total FROM i",
    "html_lists": r"""
        SELECT record_id, t AS title, list_date FROM (SELECT record_id, list_date, regexp_replace(coalesce(title, ''), '[^一-龥A-Za-z]', '', 'g') AS t FROM policies WHERE list_date IS NOT NULL AND url IS NOT NULL AND column_id IS NOT NULL)
        WHERE length(t) >= 9 AND regexp_matches(list_date, '(20[0-9]{2})[-年/.]([0-9]{1,2})[-月/.]([0-9]{1,2})日?')""",
    "json_store": "SELECT record_id, id, title, sha256(coalesce(content_text, '')) AS body, coalesce(len(attachments), -1) AS files FROM policies",
    "json_list": f"SELECT record_id, u.url AS link, coalesce(title, '') AS title, {_iso("coalesce(list_date, '')")} AS list_date, coalesce(list_date, '') AS listed FROM policies JOIN ({_URL}) u USING (record_id) WHERE u.url IS NOT NULL",
}
