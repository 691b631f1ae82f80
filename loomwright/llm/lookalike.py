"""One consistent form for text that reads the same.

``canonical_texts`` explodes the distinct texts to positioned code points, broadcast-joins them
with one mapping (compatibility decomposition, look-alike letters, white space and invisible
characters to nothing, quotation marks and hyphens to one each), orders combining marks by class
within each starter's run, composes marks with their starters again and rebuilds the strings.

The mapping covers Unicode as Python's ``unicodedata`` knows it, about 7,000 characters whatever
the data, so its broadcast has a fixed size (under 1 MB).  Each distinct text is worked on once,
however many rows hold it; the only grouping is by text, so no group grows with the data.

Defined results: a null text gives no row; an empty text, and a text of white space or invisible
characters only, give ''; letter case, digits and words are kept; repeated texts give one row; an
empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwright.session import materialise

# Letters that look like the Latin letter (or sign) below them.
LOOK_ALIKES = {
    "A": "ΑАᎪ", "B": "ΒВᏴ", "C": "СᏟϹ", "D": "Ꭰ", "E": "ΕЕᎬ", "F": "Ϝ", "G": "ԌᏀ", "H": "ΗНᎻ", "I": "ΙІӀ", "J": "ЈᎫͿ", "K": "ΚКᏦ",
    "L": "Ꮮ", "M": "ΜМᎷϺ", "N": "Ν", "O": "ΟОՕ", "P": "ΡРᏢ", "Q": "Ԛ", "R": "Ꭱ", "S": "ЅᏚՏ", "T": "ΤТᎢ", "V": "ᏙѴ", "W": "ԜᎳ", "X": "ΧХ",
    "Y": "ΥҮУ", "Z": "ΖᏃ", "a": "аα", "b": "Ь", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡց", "h": "һ", "i": "іιı", "j": "јϳ", "k": "κ",
    "l": "ӏ", "n": "ո", "o": "оοօ", "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "υս", "v": "νѵ", "w": "ԝ", "x": "хχ", "y": "уγү",
    "〇": "○◯⭘", "·": "‧・•∙⋅", "…": "⋯", "~": "∼〜", "/": "∕⁄", ":": "∶", "|": "∣ǀ",
}
# Scripts of which many letters copy Latin ones, as pairs of a letter and the Latin letter it looks like.
# Lisu and Canadian syllabics: capitals.  Coptic: capitals, then small letters.  Small capitals and other phonetic
# letters, Cherokee small letters and modifier letters: small letters.
COPIES = (
    "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU "
    "ᐯV ᑌU ᑭP ᑯd ᒍJ ᒪL ᕼH ᕽX ᖇR ᖯb ᖴF ᗅA ᗞD ᗪD ᗰM ᗷB ᙭X "
    "ⲀA ⲂB ⲌZ ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲢP ⲤC ⲦT ⲨY ⲬX ⲟo ⲣp ⲥc ⲓi ⲩy ⲭx "
    "ɑa ᴄc ᴏo ᴜu ᴠv ᴡw ᴢz ꜱs ɩi ʏy ꭵi ꮁr ꮃw ꮓz ꮩv ꮪs ꮯc"
)
# Radicals without a decomposition and the ideographs they look like.
RADICALS = "⺁⺇⺈⺊⺌⺎⺐⺒⺓⺕⺛⺜⺝⺠⺩⺪⺫⺬⺶⺻⺽⻁⻄⻅⻆⻉⻊⻋⻑⻓⻔⻗⻘⻙⻚⻛⻜⻝⻢⻣⻤⻥⻦⻧⻨⻩⻪⻬⻮⻯⻰"
IDEOGRAPHS = "厂几刀卜小兀尢巳幺彐旡日月民王疋目示羊聿臼虎西见角贝足车長长门雨青韦页风飞食马骨鬼鱼鸟卤麦黄黾齐齿竜龙"
# Marks that read as a quotation mark and as a hyphen.
QUOTES = "\"'“”„‟‘’‚‛«»‹›「」『』〝〞〟`´′″＂＇ʼʹʻʽˈ"
HYPHENS = "-‐‑‒–—―−⁃﹘﹣－➖─━"
#: Invisible though not of the general categories Cf, Cc and Z.
INVISIBLE = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ⠀"


@lru_cache(1)
def mapping() -> dict[str, str]:
    """What each character becomes; those that stay as they are are not in it."""
    table: dict[str, str] = {}
    single = {c: to for to, own in LOOK_ALIKES.items() for c in own} | dict(zip(RADICALS, IDEOGRAPHS))
    single |= {pair[0]: pair[1] for pair in COPIES.split()}
    single |= dict.fromkeys(QUOTES, '"') | dict.fromkeys(HYPHENS, "-")

    def settled(c: str) -> str:
        out = []
        for part in unicodedata.normalize("NFKD", c) if not 0xAC00 <= ord(c) <= 0xD7A3 else c:
            part = single.get(part, part)
            kind = unicodedata.category(part)
            if kind[0] == "Z" or kind in ("Cf", "Cc") or part.isspace() or part in INVISIBLE or 0xFE00 <= ord(part) <= 0xFE0F or 0xE0100 <= ord(part) <= 0xE01EF:
                continue
            out.append(part)
        return "".join(out)

    for code in range(0x110000):
        if 0xD800 <= code <= 0xDFFF:
            continue
        c = chr(code)
        if (to := single.get(c)) is None:
            to = settled(c)
        if to != c:
            table[c] = to
    return table


@lru_cache(1)
def marks() -> dict[str, int]:
    """Combining class of each mark that has one."""
    return {chr(c): k for c in range(0x300, 0x1F000) if not 0xD800 <= c <= 0xDFFF and (k := unicodedata.combining(chr(c)))}


@lru_cache(1)
def compositions() -> dict[str, str]:
    """Starter and mark to the character they compose to (primary composites)."""
    pairs: dict[str, str] = {}
    for code in range(0xC0, 0x1F000):
        c = chr(code)
        if 0xAC00 <= code <= 0xDFFF or len(parts := unicodedata.decomposition(c).split()) != 2 or parts[0][0] == "<":
            continue
        pair = "".join(chr(int(p, 16)) for p in parts)
        if unicodedata.normalize("NFC", pair) == c:
            pairs[pair] = c
    return pairs


def map_table(spark: SparkSession) -> DataFrame:
    """(c, parts): each changed character or combining mark, with the code points it becomes and their classes."""
    import pandas as pd

    table, classes = mapping(), marks()
    rows = {c: [{"c": x, "k": classes.get(x, 0)} for x in to] for c, to in table.items()}
    rows |= {c: [{"c": c, "k": k}] for c, k in classes.items() if c not in table}
    frame = pd.DataFrame({"c": list(rows), "parts": list(rows.values())})
    return spark.createDataFrame(frame, "c string, parts array<struct<c:string,k:int>>")


def _once(value, use):
    """``use(value)`` with the value bound to a lambda variable, so that it is computed once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _follows(part):
    """Marks, and Hangul vowels and trailing consonants, belong to the run of what stands before."""
    code = F.ascii(part["c"])
    return (part["k"] > 0) | ((code >= 0x1161) & (code < 0x11C3))


def _compose(run):
    """One run as a string: its marks ordered by class, then joined to the starter unless one of the same class stands between."""
    table = compositions()
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    ordered = F.array_sort(F.transform(run, lambda p, i: F.struct(p["k"].alias("k"), i.alias("i"), p["c"].alias("c"))))

    def syllable(start, code):
        # Hangul is composed by rule: leading consonant and vowel, then a trailing consonant
        left = F.ascii(start)
        lead = (left >= 0x1100) & (left < 0x1113) & (code >= 0x1161) & (code < 0x1176)
        tail = (left >= 0xAC00) & (left <= 0xD7A3) & ((left - 0xAC00) % 28 == 0) & (code > 0x11A7) & (code < 0x11C3)
        number = F.when(lead, 0xAC00 + ((left - 0x1100) * 21 + (code - 0x1161)) * 28).when(tail, left + (code - 0x11A7))
        return F.decode(F.unhex(F.hex(number)), "UTF-16BE")

    def state(start, rest, last):
        return F.struct(start.alias("start"), rest.alias("rest"), last.alias("last"))

    def step(so, part):
        joined = F.when((part["k"] > so["last"]) & (F.length(so["start"]) == 1), F.try_element_at(known, F.concat(so["start"], part["c"]))).when((part["k"] == 0) & (F.length(so["rest"]) == 0), syllable(so["start"], F.ascii(part["c"])))
        return (
            F.when(F.length(so["start"]) == 0, state(part["c"], F.lit(""), F.when(part["k"] == 0, 0).otherwise(255)))
            .when(joined.isNotNull(), state(joined, so["rest"], so["last"]))
            .otherwise(state(so["start"], F.concat(so["rest"], part["c"]), part["k"]))
        )

    return F.aggregate(ordered, state(F.lit(""), F.lit(""), F.lit(0)), step, lambda so: F.concat(so["start"], so["rest"]))


def _rebuild(parts):
    """The string of all parts, each run ordered and composed; linear in their number."""
    def runs(p):
        begins = F.filter(F.sequence(F.lit(1), F.size(p)), lambda i: (i == 1) | ~_follows(F.element_at(p, i)))
        pieces = _once(begins, lambda b: F.zip_with(b, F.concat(F.slice(b, 2, F.size(b)), F.array(F.size(p) + 1)), lambda i, j: F.slice(p, i, j - i)))
        return F.array_join(F.transform(pieces, lambda run: F.when(F.size(run) == 1, F.element_at(run, 1)["c"]).otherwise(_compose(run))), "")

    return _once(parts, runs)


def canonical_texts(texts: DataFrame, column: str) -> DataFrame:
    """(text, form): every distinct non-null text and the form by which it compares."""
    spark = texts.sparkSession
    distinct = texts.select(F.col(column).alias("text")).where(F.col("text").isNotNull()).distinct()
    points = distinct.select("text", F.posexplode_outer(F.regexp_extract_all("text", F.lit("(?s)."), F.lit(0))).alias("at", "c"))
    mapped = points.join(F.broadcast(map_table(spark)), "c", "left")
    plain = F.array(F.struct(F.col("c").alias("c"), F.lit(0).alias("k")))
    rebuilt = mapped.groupBy("text").agg(
        F.array_sort(F.collect_list(F.struct("at", F.coalesce("parts", plain).alias("parts")))).alias("points"),
        F.max(F.coalesce(F.exists("parts", _follows), F.lit(False)) | F.ascii("c").between(0x1161, 0x11C2)).alias("composes"),
    )
    parts = F.flatten(F.transform("points", lambda p: p["parts"]))
    return rebuilt.select("text", F.when(F.col("composes"), _rebuild(parts)).otherwise(F.array_join(F.transform(parts, lambda p: p["c"]), "")).alias("form"))


def same_reading_pairs(rows: DataFrame, id_col: str, column: str) -> DataFrame:
    """(id_a, id_b), a < b: rows whose texts differ in their code points yet read the same.

    Works on distinct texts: only forms shared by several texts go on, those texts are paired, and
    the pairs are expanded to rows last, so that copies of one text are never paired.
    """
    forms = materialise(canonical_texts(rows, column), "forms")
    shared = forms.groupBy("form").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("form")
    groups = forms.join(shared, "form", "left_semi")
    pairs = groups.alias("a").join(groups.alias("b"), (F.col("a.form") == F.col("b.form")) & (F.col("a.text") < F.col("b.text"))).select(F.col("a.text").alias("left"), F.col("b.text").alias("right"))
    owners = rows.select(F.col(id_col).alias("id"), F.col(column).alias("text"))
    found = pairs.join(owners.select(F.col("id").alias("l"), F.col("text").alias("left")), "left").join(owners.select(F.col("id").alias("r"), F.col("text").alias("right")), "right")
    return found.select(F.least("l", "r").alias(f"{id_col}_a"), F.greatest("l", "r").alias(f"{id_col}_b"))
