"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The short escapes of JSON strings.
SHORT_ESCAPES = {"\b": "\\b", "\f": "\\f", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def json_string(col: Column) -> Column:
    """The column as a JSON value, byte for byte as Python's ``json.dumps(..., ensure_ascii=False)``: null, or a quoted string."""
    text = F.replace(F.replace(col, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    escaped = text
    for code in range(0x20):
        escaped = F.replace(escaped, F.lit(chr(code)), F.lit(SHORT_ESCAPES.get(chr(code), f"\\u{code:04x}")))
    # the long chain of replacements only runs for the few texts that hold a control character
    text = F.when(F.rlike(col, F.lit(r"[\x00-\x1f]")), escaped).otherwise(text)
    return F.coalesce(F.concat(F.lit('"'), text, F.lit('"')), F.lit("null"))


def fingerprint(rule: str, title: Column, content_hash: Column, attachments_hash: Column) -> Column:
    """SHA-256 of the JSON array [rule, title, content_hash, attachments_hash]."""
    parts = [json_string(F.lit(rule)), json_string(title), json_string(content_hash), json_string(attachments_hash)]
    return F.sha2(F.concat(F.lit("["), F.concat_ws(", ", *parts), F.lit("]")), 256)


#: Fixed value: how a date is written in titles, lists and pages.
DATE = r"(20[0-9]{2})[-年/.]([0-9]{1,2})[-月/.]([0-9]{1,2})日?"
#: Python's ``\s`` over Unicode text, as a Java class.
SPACE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}]"


def clean(col: Column) -> Column:
    """Runs of white space as one space, none at the ends; null is ''."""
    return F.trim(F.regexp_replace(F.coalesce(col, F.lit("")), SPACE + "+", " "))


def compact(col: Column) -> Column:
    """The text without white space; null stays null."""
    return F.regexp_replace(col, SPACE + "+", "")


def iso_date(col: Column) -> Column:
    """The first date written in the text as YYYY-MM-DD; null if there is none or it does not exist. Later dates are not tried."""
    part = lambda i: F.regexp_extract(col, DATE, i)
    written = F.concat_ws("-", part(1), F.lpad(part(2), 2, "0"), F.lpad(part(3), 2, "0"))
    return F.date_format(F.try_to_timestamp(F.when(F.rlike(col, F.lit(DATE)), written), F.lit("yyyy-MM-dd")), "yyyy-MM-dd")


def plain_title(col: Column) -> Column:
    """A title without white space and zero-width marks, with straight quotation marks; no compatibility forms."""
    bare = F.regexp_replace(F.coalesce(col, F.lit("")), r"[\s\x{1c}-\x{1f}\x{85}\p{Z}\x{200b}\x{feff}]+", "")
    return F.translate(bare, "“”‘’", "\"\"''")


def normalized_title(col: Column) -> Column:
    """``plain_title`` of the title in compatibility form (NFKC), which only Python offers: Arrow batches."""
    @F.pandas_udf("string")
    def nfkc(s):
        return s.str.normalize("NFKC")

    return plain_title(nfkc(col))


# Organisations whose names begin a title, longer names first, what follows them, and the form of a number within a title.
ISSUERS = ("国家能源局南方监管局", "国家能源局综合司", "国家能源局", "广东省发展和改革委员会", "广东省发展改革委", "广东省能源局", "南方能源监管局", "国家发展和改革委员会", "国家发展改革委", "广东省人民政府")
AFTER_ISSUER = ("关于", "行政许可通告", "公告", "通告", "通知", "公示", "令")
TITLE_NUMBER = r"国家能源局公告[\s\p{Z}]*20[0-9]{2}年第[0-9]+号"
#: An organisation by its last word, for titles of organisations that no list names.
ANY_ISSUER = r"[^，。；：:《》]{2,65}?(?:局|厅|委员会|委|部|办公室|分行|人民政府|司|中心)"
#: A number such as 能规〔2024〕404号.
ANY_NUMBER = r"[\x{4e00}-\x{9fff}A-Za-z]{1,20}[〔\[［(（]20[0-9]{2}[〕\]］)）]\s*[0-9]+号"


def document_number(col: Column, form: str = TITLE_NUMBER) -> Column:
    """The document number that a title states, cleaned; null if there is none."""
    return F.nullif(clean(F.regexp_extract(col, form, 0)), F.lit(""))


def title_issuer(col: Column, form: str = "|".join(ISSUERS)) -> Column:
    """The organisation that a title begins with, before what it is about; null if there is none."""
    found = F.regexp_extract(col, f"^({form})[\\s\\p{{Z}}]*(?=" + "|".join(AFTER_ISSUER) + ")", 1)
    return F.nullif(found, F.lit(""))


def standalone_number(text: Column, lines: int = 15) -> Column:
    """A document number that fills one of the first lines."""
    form = r"^[\x{4e00}-\x{9fff}A-Za-z]{1,20}[〔\[［(]20[0-9]{2}[〕\]］)]\s*[0-9]+号$"
    return F.try_element_at(F.filter(F.slice(F.split(text, "\n"), 1, lines), lambda line: F.rlike(line, F.lit(form))), F.lit(1))


def ungrounded_numbers(output: Column, source: Column) -> Column:
    """Numbers of the output that do not stand in the source as substrings, in order of appearance."""
    return F.filter(F.regexp_extract_all(output, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0)), lambda n: ~F.contains(source, n))


def quotes_grounded(quotes: Column, source: Column, least: int = 8) -> Column:
    """Whether every quote has at least ``least`` characters and stands in the source, white space aside."""
    bare = compact(source)
    return F.forall(quotes, lambda q: (F.length(q) >= least) & F.contains(bare, compact(q)))


def keyword_hits(text: Column, keywords: list[str]) -> Column:
    """Keywords that stand in the text, in the given order; case counts."""
    return F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(text, k))


def all_terms(text: Column, query: str) -> Column:
    """Whether every white-space separated term of the query stands in the text, case aside; an empty query always does."""
    hay, found = F.lower(text), F.lit(True)
    for term in query.split():
        found = found & F.contains(hay, F.lit(term.lower()))
    return found


def shortened(text: Column, limit: int) -> Column:
    """The first ``limit`` code points."""
    return F.substring(text, 1, limit)


def extension(name: Column) -> Column:
    """Lower-case extension of a file name or path; null if there is none."""
    return F.nullif(F.lower(F.regexp_extract(name, r"\.([^./?#]+)(?:[?#].*)?$", 1)), F.lit(""))


def bytes_within(text: Column, limit: int) -> Column:
    """Whether the UTF-8 form has at most ``limit`` bytes."""
    return F.octet_length(text) <= limit


def relevance_text(title: Column, body: Column, attachment_texts: Column, limit: int = 2000) -> Column:
    """What a first reading gets: the title, then the first ``limit`` code points of the body and of all attachment texts, under fixed headings."""
    files = F.array_join(F.filter(F.coalesce(attachment_texts, F.array().cast("array<string>")), lambda t: F.coalesce(t, F.lit("")) != ""), "\n")
    parts = [F.coalesce(title, F.lit("")), F.lit("\n正文：\n"), F.substring(F.coalesce(body, F.lit("")), 1, limit), F.lit("\n附件解析文本：\n"), F.substring(files, 1, limit)]
    return F.concat(*parts)
