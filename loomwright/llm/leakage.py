"""Passages of held-out test items inside a corpus, by pigeonhole edit matching.

A passage is ``window`` consecutive letters or digits of an item, found in a document with at most
``errors`` edits.  Each item is split at multiples of ``piece`` characters, with
``piece = (window + 1) // (errors + 2)``: any window, wherever it begins, then holds at least
``errors + 1`` whole pieces, so with ``errors`` edits one piece survives unchanged.  Exact piece
hits come from one Aho-Corasick pass over each document.  Each hit proposes windows of the item and
the stretch of the document each must lie in; Myers' bit-parallel distance decides, for all proposals
of a batch at once (``myers_many``).

The items are a stated query set: they are measured first and sent to the executors in blocks of
at most ``block_chars`` characters; the corpus is read once for each block and never shuffled.

Defined results: a null or empty text or item matches nothing; items shorter than the window match
nothing; one row for each document row and item id, however often it matches; repeated documents
each give their own rows, rows with one item id count as one item; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

WINDOW = 40
BLOCK_CHARS = 8_000_000


def letters_only(text: str | None) -> str:
    """NFKC, lower case, then letters and numbers alone."""
    import regex

    if not text:
        return ""
    if not unicodedata.is_normalized("NFKC", text):
        text = unicodedata.normalize("NFKC", text)
    return regex.sub(r"[^\p{L}\p{N}]+", "", text.lower())


def myers(pattern: str, text: str) -> int:
    """Smallest edit distance of ``pattern`` to any substring of ``text`` (Myers 1999)."""
    m = len(pattern)
    if not m:
        return 0
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, high = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score, best = full, 0, m, m
    for c in text:
        eq = masks.get(c, 0)
        xv = eq | minus
        xh = (((eq & plus) + plus) ^ plus) | eq
        ph = minus | (~(xh | plus) & full)
        mh = plus & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = (ph << 1) & full
        mh = (mh << 1) & full
        plus = mh | (~(xv | ph) & full)
        minus = ph & xv
        best = min(best, score)
    return best


def myers_many(patterns, texts):
    """``myers`` of many pairs at once: rows of code points, patterns of one length up to 64, texts padded at the end with 0.

    Every step advances all pairs by one character with the same bit operations on 64-bit words.
    """
    import numpy as np

    count, m = patterns.shape
    one = np.uint64(1)
    places = one << np.arange(m, dtype=np.uint64)
    full = np.uint64((1 << m) - 1)
    high = places[-1]
    plus, minus = np.full(count, full), np.zeros(count, dtype=np.uint64)
    score = np.full(count, m, dtype=np.int32)
    best = score.copy()
    for column in texts.T:
        eq = ((patterns == column[:, None]) * places).sum(axis=1, dtype=np.uint64)
        xv = eq | minus
        xh = ((((eq & plus) + plus) & full) ^ plus) | eq
        ph = minus | (~(xh | plus) & full)
        mh = plus & xh
        score += (ph & high) != 0
        score -= (mh & high) != 0
        ph, mh = (ph << one) & full, (mh << one) & full
        plus, minus = mh | (~(xv | ph) & full), ph & xv
        # the padding after a text matches nothing and does not count
        np.minimum(best, np.where(column != 0, score, best), out=best)
    return best


class Matcher:
    """Finds which items of a block leak into texts."""

    #: Proposals verified at once.
    CHUNK = 20_000

    def __init__(self, items: list[tuple[int, str]], window: int = WINDOW, errors: int = 0):
        import ahocorasick

        self.window, self.errors = window, errors
        self.piece = (window + 1) // (errors + 2)
        if self.piece < 1 or window > 64:
            raise ValueError("too many errors for this window, or a window over 64")
        self.items = [(key, text) for key, text in ((k, letters_only(t)) for k, t in items) if len(text) >= window]
        places: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for number, (_, text) in enumerate(self.items):
            for at in range(0, len(text) - self.piece + 1, self.piece):
                places[text[at : at + self.piece]].append((number, at))
        self.automaton = ahocorasick.Automaton()
        for piece, own in places.items():
            self.automaton.add_word(piece, own)
        if places:
            self.automaton.make_automaton()
        else:
            self.automaton = None

    def proposals(self, text: str) -> set[tuple[int, int, int]]:
        """(item, begin of a window in it, where that lies in the text) of the windows that a piece hit makes possible."""
        found: set[tuple[int, int, int]] = set()
        tried: set[tuple[int, int, int]] = set()
        for end, places in self.automaton.iter(text):
            where = end - self.piece + 1
            for number, at in places:
                item, shift = self.items[number][1], where - at
                # pieces that follow each other on one diagonal are one passage
                follows = (number, shift, at - self.piece) in tried
                tried.add((number, shift, at))
                if self.errors:
                    first, last = max(0, at + self.piece - self.window), min(at, len(item) - self.window)
                    found.update((number, begin, begin + shift) for begin in range(first, last + 1))
                elif not follows:
                    # without errors only the window from where the passage begins can decide
                    begin = at
                    while begin > 0 and begin + shift > 0 and at - begin < self.window and item[begin - 1] == text[begin + shift - 1]:
                        begin -= 1
                    if begin + self.window <= len(item):
                        found.add((number, begin, begin + shift))
        return found

    def leaks(self, texts: list[str | None]) -> list[list[int]]:
        """For each text the keys of the items that leak into it, each once."""
        import numpy as np

        found: list[dict[int, None]] = [{} for _ in texts]
        bare = [letters_only(t) for t in texts] if self.automaton is not None else []
        waiting: list[tuple[int, int, str, str]] = []

        def verify() -> None:
            span = self.window + 2 * self.errors
            codes = lambda strings, n: np.frombuffer("".join(x.ljust(n, "\0") for x in strings).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(-1, n)
            near = myers_many(codes([w[2] for w in waiting], self.window), codes([w[3] for w in waiting], span)) <= self.errors
            for (at, number, *_), fits in zip(waiting, near):
                if fits:
                    found[at][number] = None
            waiting.clear()

        for at, text in enumerate(bare):
            if len(text) < self.window - self.errors:
                continue
            for number, begin, where in self.proposals(text):
                if number not in found[at]:
                    waiting.append((at, number, self.items[number][1][begin : begin + self.window], text[max(0, where - self.errors) : max(0, where + self.window + self.errors)]))
                    if len(waiting) >= self.CHUNK:
                        verify()
        if waiting:
            verify()
        return [list(dict.fromkeys(self.items[number][0] for number in own)) for own in found]


def leaking_documents(
    documents: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    errors: int = 0,
    block_chars: int = BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id) of every document that holds a passage of an item."""
    spark = documents.sparkSession
    queries = items.select(F.col(item_id).alias("k"), F.col(item_text).alias("t")).where(F.length("t") >= 1)
    chars = queries.agg(F.coalesce(F.sum(F.length("t")), F.lit(0)).alias("n")).first()["n"]
    blocks = max(1, -(-int(chars) // block_chars))
    schema = T.StructType([T.StructField("doc_id", documents.schema[doc_id].dataType), T.StructField("item_id", items.schema[item_id].dataType)])
    item_type = to_arrow_type(items.schema[item_id].dataType)
    read = documents.select(F.col(doc_id).alias("d"), F.col(doc_text).alias("t"))
    result = None
    for block in range(blocks):
        own = [(r["k"], r["t"]) for r in queries.where(F.pmod(F.xxhash64("k"), F.lit(blocks)) == block).collect()]
        shared = spark.sparkContext.broadcast(own)

        def run(batches, shared=shared):
            import pyarrow as pa

            matcher = Matcher(shared.value, window, errors)
            for batch in batches:
                keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                left, right = [], []
                for key, items in zip(keys, matcher.leaks(texts)):
                    for item in items:
                        left.append(key)
                        right.append(item)
                types = batch.schema.field(0).type, item_type
                yield pa.RecordBatch.from_arrays([pa.array(own, type=kind) for own, kind in zip((left, right), types)], names=["doc_id", "item_id"])

        part = read.mapInArrow(run, schema)
        result = part if result is None else result.unionByName(part)
    return result.withColumnRenamed("doc_id", doc_id).withColumnRenamed("item_id", item_id)
