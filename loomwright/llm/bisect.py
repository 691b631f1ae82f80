"""Splitting oversized texts at natural boundaries by recursive bisection.

A text over the limit is cut at the strongest boundary near its middle (blank line, line, sentence,
clause, word, else any place that keeps a character with its marks); halves longer than
``limit - overlap`` are cut again.  Every piece but the first then begins ``overlap`` characters
earlier, so no piece is longer than ``limit`` and consecutive pieces share ``overlap`` characters.

Only texts over the limit go to Python.  There is no shuffle.

Defined results: a null text gives no piece; an empty text gives one empty piece; a text of up to
``limit`` characters gives itself; repeated rows are each split; a text without any boundary is cut
in even halves; an empty table gives an empty table.  Lengths are in code points.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LIMIT = 2000
OVERLAP = 200

# Boundaries from the strongest to the weakest; a cut comes after them.
BOUNDARIES = [["\n\n"], ["\n"], ["。", "！", "？", ". ", "! ", "? "], ["；", ";", "："], ["，", "、", ", "], [" ", "\t", "　"]]


def joined(text: str, at: int) -> bool:
    """Whether a cut before ``text[at]`` would part a character from its marks."""
    after, before = text[at], text[at - 1]
    return bool(unicodedata.combining(after)) or after in "︎️‍" or before == "‍" or (before == "\r" and after == "\n")


def cut_near(text: str, begin: int, end: int) -> int:
    """The strongest boundary within a quarter of the span around its middle; the nearest of equals."""
    middle, reach = (begin + end) // 2, max(1, (end - begin) // 4)
    low, high = max(begin + 1, middle - reach), min(end - 1, middle + reach)
    for marks in BOUNDARIES:
        best = -1
        for mark in marks:
            n = len(mark)
            before = text.rfind(mark, low - n if low >= n else 0, middle) + n
            if before - n >= 0 and low <= before <= high and (best < 0 or abs(before - middle) < abs(best - middle)):
                best = before
            after = text.find(mark, max(middle - n + 1, 0), high) + n
            if after - n >= 0 and low <= after <= high and (best < 0 or abs(after - middle) < abs(best - middle)):
                best = after
        if best >= 0 and not joined(text, best):
            return best
    for step in range(reach):
        for at in (middle + step, middle - step):
            if low <= at <= high and not joined(text, at):
                return at
    return middle


def cuts(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[int]:
    """Begin of every piece's own part, and the end of the text."""
    if len(text) <= limit:
        return [0, len(text)]
    if not 0 <= overlap < limit - 1:
        raise ValueError("the overlap must be smaller than the limit")
    room, done, spans = limit - overlap, [0], [(0, len(text))]
    while spans:
        begin, end = spans.pop()
        if end - begin <= room:
            done.append(end)
        else:
            at = cut_near(text, begin, end)
            spans += [(at, end), (begin, at)]
    return done


def split(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[dict]:
    """The pieces of one text, each with the place where it starts."""
    at = cuts(text, limit, overlap)
    starts = [0, *(begin - overlap for begin in at[1:-1])]
    return [{"start": start, "text": text[start:end]} for start, end in zip(starts, at[1:])]


def pieces(text: Column, limit: int = LIMIT, overlap: int = OVERLAP) -> Column:
    """array<struct<start, text>> of a text; start counts from 0."""
    kind = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("text", T.StringType())]))

    @F.pandas_udf(kind)
    def bisected(texts):
        return texts.map(lambda t: None if t is None else split(t, limit, overlap))

    whole = F.array(F.struct(F.lit(0).alias("start"), text.alias("text")))
    return F.when(F.length(text) > limit, bisected(F.when(F.length(text) > limit, text))).when(text.isNotNull(), whole)


def split_items(items: DataFrame, keys: list[str], text_col: str, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(keys, piece_no, start, text): the pieces of every item, numbered from 1."""
    parts = items.select(*keys, pieces(F.col(text_col), limit, overlap).alias("_parts"))
    return parts.select(*keys, F.posexplode("_parts").alias("_n", "_part")).select(*keys, (F.col("_n") + 1).alias("piece_no"), F.col("_part.start").alias("start"), F.col("_part.text").alias("text"))


def policy_items(policies: DataFrame) -> DataFrame:
    """(record_id, attachment_no, text): the body of each record, and each attachment by its place."""
    body = F.array(F.struct(F.lit(0).cast("long").alias("attachment_no"), F.col("content_text").alias("text")))
    attached = F.transform("attachments", lambda a, i: F.struct((i + 1).cast("long").alias("attachment_no"), a["text"].alias("text")))
    return policies.select("record_id", F.inline(F.concat(body, F.coalesce(attached, F.array().cast("array<struct<attachment_no:bigint,text:string>>")))))
