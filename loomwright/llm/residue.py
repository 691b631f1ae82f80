"""Template residue and error pages: records to leave out.

Records made by one template say the same around their slots.  What a slot may keep instead of a value
(a variable name or hint to the writer, a program's default, filler, a notice) has a form by which the
places that hold it are found; a place counts through the other records it is aligned with:

* ``slot``: the characters before or after the place, numbers masked, stand in other records too, and
  there at least ``SHARED`` different values stand where the residue stands here (``open_anchors``, one
  vectorised pass over all texts whatever fills the slot there).  A place that fills whole lines is
  aligned by its line: lines are slots of a page (``line``).
* ``page``: the whole page is an error, block, login, maintenance or script notice, and with numbers,
  paths and stack frames masked it stands at least ``SHARED`` times in the corpus.
* ``form``: what no other record aligns with is left to its form alone (README gives the share).

Defaults that can also be words of a sentence (``N/A``, ``XX``, bare variable names) count only where
clauses of other records fill the same place in three or more ways (``aligned_slots``).

Filler is found by repetition and low entropy: one unit said over and over, or a run of words of the
usual Latin dummy vocabulary.  Sentences that stand among such filler in at least ``SHARED`` different
surroundings, and hardly elsewhere, are filler too (``filler_sentences``).  Notices count as a whole page of any length, and as a line or sentence
of a text of any length.  Markers that are quoted or spoken about ("the field “{{name}}” is replaced
...") are not residue.  Blanks are forms to sign, not residue.

Shuffled are masked notice pages, anchors with at most ``SHARED`` values each from every batch, and
clauses that share their ends with a clause that holds a loose default.  The only broadcast is a bitmap
of anchors of fixed size.

Defined results: null, empty and blank texts are never marked; repeated texts are each marked; one
row for each marked row; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwright.session import materialise

#: A frame or a page counts as shared by records from this many on.
SHARED = 3
#: Characters before or after a place by which records are aligned.
ANCHOR = 4
#: Fewest characters of a sentence that can be learned as filler.
FILLER_CHARS = 6
#: Bits of the map of anchors that is broadcast (2 MB).
BITS = 1 << 24
#: From this many characters on, a page of notices is held to one sentence a line.
LONG_PAGE = 600

NAME = r"[A-Za-z_一-龥][\w.一-龥]{0,40}"
# Forms in which template languages, form letters and editors mark a field.
FIELD_FORMS = [
    r"\{\{[^{}\n]{1,80}\}\}",
    r"[$#]!?\{[^{}\n]{1,80}\}",
    r"\{[$%#][^{}\n]{1,80}\}",
    r"<%[^<>\n]{1,80}%>",
    r"\[%[^\[\]\n]{1,80}%\]",
    r"\[\[[^\[\]\n]{1,60}\]\]",
    r"<#[^<>\n]{1,60}>",
    r"«" + NAME + "»",
    r"@@" + NAME + "@@",
    r"(?<!_)__[A-Za-z一-龥][\w.一-龥]{0,40}?__(?!_)",
    r"%[A-Za-z_.一-龥]{1,30}%",
    r"(?<![\\\w$#{])\{" + NAME + r"\}(?!\})",
    r"\{ ?MERGEFIELD[^{}\n]{1,60}\}",
    r"<[a-z]{1,10}:[a-z]{1,20} [^<>\n]{1,80}/>",
    r"(?:[【\[［<〈]|[（(](?=请在此|此处|在此))(?:请|此处|在此|点击此处)[^【】\[\]［］<>〈〉（）()\n]{0,24}?(?:填写|输入|插入|键入|补充|填入|粘贴|替换)[^【】\[\]［］<>〈〉（）()\n]{0,24}[】\]］>〉）)]",
    r"[【\[［（(][^【】\[\]［］（）()\n]{0,20}(?:待补充|待填写|待完善|待录入|待更新)[】\]］）)]",
    r"X{3,}[（(][^（）()\n]{0,30}替换[）)]",
    r"(?i:[\[<(](?:insert|enter|your|add|type|replace)\b[^\[\]<>()\n]{1,40}(?:here|name|date|title|text|number|address)[\]>)])",
]
# What programs write where a value is missing.
DEFAULTS = r"(?:null|undefined|NaN|None|\[object Object\]|\{\})"
# what a slot may keep instead of a value, to be judged by aligned records
LOOSE = r"(?:null|undefined|NaN|None|N/A|XX+|××+|\[object Object\]|(?<![\w./@:-])[a-z]{1,20}(?:_[a-z0-9]{1,20}){1,4}(?![\w./@:-])|(?<![\w./@:-])[a-z]{2,20}[A-Z][a-z]{1,20}[A-Za-z]{0,20}(?![\w./@:-]))"
#: Characters of a clause's ends by which clauses find each other, and of the far side of a slot.
ENDS, FAR_SIDE = 3, 6
#: Longest value of a slot, in characters.
FILL_CHARS = 40
# Words of the usual Latin dummy text.
LATIN = (
    "ad adipiscing aliqua aliquip amet anim aute cillum commodo consectetur consequat culpa cupidatat deserunt do dolor dolore duis ea eiusmod elit enim esse est et eu ex "
    "excepteur exercitation fugiat id in incididunt ipsum irure labore laboris laborum lorem magna minim mollit nisi non nostrud nulla occaecat officia pariatur proident qui quis "
    "reprehenderit sed sint sit sunt tempor ullamco ut velit veniam voluptate"
)
# one unit said over and over: a character five times, two or three characters or a word three times, a phrase twice
# a character that comes again within a phrase's length is looked for first, as most do not
REPEATS = (
    r"(?P<a>[一-龥])(?=[一-龥]{0,7}(?P=a))(?:(?P=a){4}|(?P<b>[一-龥])(?P=a)(?P=b)(?P=a)(?P=b)|(?P<c>[一-龥]{2})(?P=a)(?P=c)(?P=a)(?P=c)|(?P<e>[一-龥]{3,7})(?P=a)(?P=e))"
    r"|(?=[A-Za-z])(?<![A-Za-z])(?P<d>[A-Za-z]{2,10}+)(?:[ ,](?P=d)){2,}(?![A-Za-z])"
)
QUOTED_BEFORE = "(?<![“‘「『\"'`])"
QUOTED_AFTER = r"(?![”’」』\"'`]|\s?(?:写法|语法|标记|格式|变量|占位符|一类|字样|提示语|syntax|notation|marker|placeholder))"

# Lines of which notices of servers, firewalls, logins and browsers consist.
NOTICES = (
    r"(?:HTTP )?[345]\d\d (?:Bad Gateway|Forbidden|Not Found|Service (?:Temporarily )?Unavailable|Gateway Time-?out|Internal Server Error|Unauthorized|Too Many Requests|- )",
    r"(?:Internal Server Error|Access denied|Error establishing a|Bad Gateway|Service Unavailable)",
    r"(?:Please |You need to |You must )?(?:enable|turn on|allow|activate) (?:your )?(?:JavaScript|scripts?|cookies)",
    r"(?:JavaScript|Scripts?|Cookies) (?:is|are|must be) (?:required|disabled|enabled|blocked|turned)",
    r"(?:Are you a robot|Checking (?:if|your)|Just a moment|Verify(?:ing)? (?:that )?you are|Complete the captcha|Oops!)",
    r"(?:The |This )?page (?:\S{1,80} )?(?:you \w{1,20} \w{1,20} )?(?:can(?:’t|'t|not| not)|could not|was not|does not) (?:be found|found|exist)",
    r"(?:Scheduled maintenance|(?:Site|System) (?:is )?under maintenance|We(?:’|')ll be back|Loading\.\.\.|Session expired|Your session|(?:Please )?(?:log|sign) in to)",
    r"(?:Traceback \(most recent|Fatal error:|Warning: \w+\(|Uncaught |java\.\w+\.|System\.\w+\.\w*Exception|org\.\w+\.\w+(?:NotFound|Exception|Error)|\w{1,30} template error|ORA-\d+|SQLSTATE)",
    r"(?:抱歉|对不起|很遗憾)?[，, ]?(?:您|你)?(?:所)?(?:访问|请求|查找|要查看)的(?:页面|网页|资源|文件|地址|内容)[^。\n]{0,60}(?:不存在|下线|删除|迁移|找不到|失效|过期)",
    r"(?:HTTP )?(?:\d{3} ?-? ?)?(?:找不到|无法找到|无法显示|无法访问)(?:该)?(?:文件|页面|网页|资源)",
    r"(?:页面不存在|页面已删除|访问被拒绝|禁止访问|拒绝访问|没有权限|无权访问|会话已过期|会话超时|登录超时|登录已失效|网关超时|网关错误|请求超时|服务器(?:开小差|内部错误|错误|繁忙)|数据库连接|系统(?:繁忙|错误|异常))",
    r"(?:系统|网站|平台|本站|服务)(?:正在)?(?:维护中|升级改造|升级维护|停机维护|维护升级|升级中)",
    r"(?:该|此|本)?(?:内容|页面|栏目|文章)?(?:需|需要|请)(?:先)?登录(?:后|以|才|查看|，|。|$)",
    r"(?:请)?(?:输入|完成)(?:图形)?验证码|正在验证您的浏览器|请求存在安全风险|您的IP",
    r"(?:请|您需要|需要)(?:先)?(?:开启|启用|打开|允许)(?:您的)?(?:浏览器)?(?:的)?[ “]?(?:JS|JavaScript|脚本|Cookie)",
    r"(?:您|你)的浏览器(?:未启用|不支持|禁用|已禁用|版本过低)|本(?:页|站)需(?:要)?脚本",
)
NOTICE = "(?:" + "|".join(NOTICES) + ")"
# what may accompany a notice: stack frames, paths, ids, server names, short advice
COMPANION = r"(?:\s*at \S+\(.*|\s*File \".*|\w*(?:Error|Exception)\b.*|/\S*|nginx.*|apache.*|.{0,120}(?i:reference|request|ray|server|upstream|permission|请求编号|事件|规则|错误码|编号|自动返回|正在跳转|返回首页|执行语句|稍后|删除|更改|不可用|谅解).{0,120})"

# Notices that fill a line or a sentence of real content, up to where they may end.
_ENDS = r"(?=\s*(?:$|[\n，,。.!！:：(（—]|- ))"
BLOCKS = (
    r"(?:HTTP )?[45]\d\d (?:Bad Gateway|Forbidden|Not Found|Service (?:Temporarily )?Unavailable|Gateway Time-?out|Internal Server Error|Unauthorized|Too Many Requests)" + _ENDS,
    r"(?:Internal Server Error|Access denied|Bad Gateway|Service (?:Temporarily )?Unavailable)" + _ENDS,
    r"Error establishing a (?:database )?connection",
    r"(?:Sorry, )?(?:Please |You need to |You must )?(?:enable|turn on|allow|activate) (?:your )?(?:JavaScript|scripts?|cookies)(?:" + _ENDS + r"| (?:to|in|and|for|before|on)\b)",
    r"(?:JavaScript|Scripts?|Cookies) (?:is|are|must be) (?:required|disabled|enabled|blocked|turned)(?:" + _ENDS + r"| (?:to|in|off|on|for)\b)",
    r"(?:Are you a robot\?|Checking (?:if the site|your browser)|Just a moment\.\.\.|Verify(?:ing)? (?:that )?you are (?:a )?human|Complete the captcha|Oops!)",
    r"(?:Sorry, )?(?:the |this )?page (?:\S{1,80} )?(?:you \w{1,20} \w{1,20} )?(?:can(?:’t|'t|not| not)|could not|was not|does not) (?:be found|found|exist)" + _ENDS,
    r"(?:(?:This |Our |The )?(?:Site|System|website) (?:is )?(?:currently )?under maintenance|We(?:’|')ll be back (?:soon|shortly))",
    r"(?:Your session (?:has )?(?:expired|timed out)|Session expired)" + _ENDS,
    r"(?:Please |You must )?(?:log|sign) in to (?:continue|view|read|see|access) ?(?:" + _ENDS + r"|(?:this|the) (?:page|article|content|full text))",
    r"(?:Traceback \(most recent call last\)|Fatal error: |Warning: \w+\(\)|Uncaught \w*(?:Error|Exception)|java\.\w+\.[\w.]*(?:Exception|Error)|System\.\w+\.\w*Exception|org\.\w+\.[\w.]*(?:NotFound|Exception|Error)|ORA-\d{5}: |SQLSTATE\[)",
    r"(?:抱歉|对不起|很遗憾)?[，, ]?(?:您|你)(?:所)?(?:访问|请求|查找|要查看)的(?:页面|网页|资源|文件|地址|内容)[^。，\n]{0,60}(?:不存在|已?下线|已?(?:被)?删除|已?迁移|找不到|已?失效|已?过期)" + _ENDS,
    r"(?:HTTP )?(?:\d{3} ?-? ?)?(?:找不到|无法找到|无法显示|无法访问)(?:该|此)?(?:文件|页面|网页|资源)" + _ENDS,
    r"(?:页面不存在|页面已删除|访问被拒绝|拒绝访问|(?:您)?(?:没有权限|无权)访问(?:该|此|本)(?:页面|内容|资源)|会话已过期|会话超时|登录超时|登录已失效|网关超时|网关错误|服务器(?:开小差(?:了)?|内部错误|错误|繁忙)|系统繁忙)" + _ENDS,
    r"(?:系统|网站|平台|本站|服务)(?:正在)?(?:维护中|停机维护中|升级维护中|升级中)" + _ENDS,
    r"(?:该|此|本)(?:内容|页面|栏目|文章)(?:需|需要)?(?:请)?(?:先)?登录(?:后|以|才)(?:能|可|方可|继续)?(?:查看|阅读|浏览|访问)",
    r"(?:请)?(?:输入|完成)(?:图形)?验证码(?:后|以)(?:继续|访问|查看)|正在验证您的浏览器|您的IP(?:访问过于频繁|已被)",
    r"(?:抱歉|对不起)?[，, ]?(?:请|您需要)(?:先)?(?:在(?:您的)?浏览器中)?(?:开启|启用|打开|允许)(?:您的)?(?:浏览器)?(?:的)?[ “]?(?:JS|JavaScript|脚本|Cookie)",
    r"(?:您|你)的浏览器(?:未启用|不支持|禁用了?|已禁用|版本过低)|本(?:页|站)需(?:要)?脚本",
)
# What a sentence says that speaks about notices.
ABOUT = r"(?i:投诉|反映|反馈称|问题|提示语|字样|一类|之类|现象|情况|次数|工单|培训|演练|应当|应由|应及|不得|\bcomplain|\breport(?:s|ed)\b|\btickets?\b|\busers\b|\bcases?\b|\bincidents?\b|\bmeans?\b|\bwording\b|\bphrase\b)"


# where a form may begin: a class is tested at every character before the alternatives are
FIELD = r"(?=[{$#<\[«@_%【［〈（(X])" + QUOTED_BEFORE + "(?:" + "|".join(FIELD_FORMS) + ")" + QUOTED_AFTER
_DEFAULT_TAIL = r"(?=\s*(?:$|[\n，。；、,;]|-" + DEFAULTS + "))"
PLACED_DEFAULT = "(?:" + "|".join([
    r"(?<=[：:])" + DEFAULTS + _DEFAULT_TAIL,
    r"(?<=[：:]\s)(?:null|undefined|NaN|\[object Object\])" + _DEFAULT_TAIL,
    QUOTED_BEFORE + r"\[object Object\]" + QUOTED_AFTER,
    r"(?:NaN|undefined|null)(?=年|月|日|元|个|万|亿|%|％|小时|分钟)",
]) + ")"
_WORDS = "|".join(LATIN.split())
LATIN_RUN = r"(?=[A-Za-z])(?<![A-Za-z])(?i:(?:" + _WORDS + r")[\s.,]+){2}(?i:" + _WORDS + r")(?![A-Za-z])"


def holds_field(text: Column) -> Column:
    """A variable name or a hint to the writer stands in the text, neither quoted nor spoken about."""
    # a plainer test first: most texts hold none of what every form needs (plain strings are found much faster than patterns)
    inner = r"[{}«»]|@@|__|\[\[|<[%#a-z]|\[%|%[A-Za-z_.一-龥]{1,30}+%|[\[<(](?i:insert|enter|your|add|type|replace)\b"
    hint = F.rlike(text, F.lit(r"(?=[{}«»@_\[<%(])(?:" + inner + ")"))
    words = ["【", "［", "〈", "XXX", *(o + w for o in "[<" for w in ("请", "此处", "在此", "点击")), *(o + w for o in "（(" for w in ("请在此", "此处", "在此")), *(f"待{w}" for w in ("补充", "填写", "完善", "录入", "更新"))]
    for word in words:
        hint = hint | F.contains(text, F.lit(word))
    return hint & F.rlike(text, F.lit(FIELD))


def holds_default(text: Column) -> Column:
    """A place that can only be a slot holds a default: after a label, before a unit, or as a reference."""
    return F.rlike(text, F.lit(r"(?=[Nuno:：])(?:NaN|undefined|null|None|object Object|[:：]\{\})")) & F.rlike(text, F.lit(PLACED_DEFAULT))


def holds_filler(text: Column) -> Column:
    """A run of dummy text: three Latin dummy words in a row, or one unit over and over."""
    typical = r"(?=[LlIiDdAaCcEeTtVvNnUuMm])(?<![A-Za-z])(?i:lorem|ipsum|dolore?|amet|consectetur|adipiscing|eiusmod|tempor|incididunt|labor(?:e|is)|aliqu(?:a|ip)|veniam|nostrud|ullamco|exercitation|nisi|magna|minim|commodo)(?![A-Za-z])"
    return (F.rlike(text, F.lit(typical)) & F.rlike(text, F.lit(LATIN_RUN))) | F.rlike(text, F.lit(re.sub(r"\(\?P=(\w)\)", r"\\k<\1>", REPEATS).replace("?P<", "?<")))


def notice_page(text: Column) -> Column:
    """The whole page is a notice: it begins with one and every other line is one or accompanies one."""
    page = F.trim(F.regexp_replace(text, r"^[\s　]+|[\s　]+$", ""))
    first = r"(?is)^[\s　]*" + NOTICE
    # judged line by line: a page may be of any length; on a long one a notice is one sentence a line
    companion = COMPANION.replace(".{0,120}", r"[^\n]{0,120}").replace(".*", r"[^\n]*")
    line = lambda rest: r"(?is)^\s*(?:" + NOTICE + rest + "|" + companion + "|)$"
    every = lambda rest: F.forall(F.split(page, "\n"), lambda x: F.rlike(x, F.lit(line(rest))))
    return F.rlike(text, F.lit(first)) & F.when(F.length(text) <= LONG_PAGE, every(r"[^\n]*")).otherwise(every(r"[^\n。.]*[。.]?\s*"))


# a class of what notices begin with is tested before the alternatives are
NOTICE_LINE = r"(?:^|[\n。！？!?][\s　]*|\. +)(?=[A-Za-z45抱对很，, 您你找无页访拒没会登网服系平本该此请输完正])(?i:" + "|".join(BLOCKS) + r")(?![^\n。！!]*" + ABOUT + r")(?!\s?[”’」』\"'`])"

def holds_notice(text: Column) -> Column:
    """A line or a sentence of the text, however long that is, is a notice, neither quoted nor spoken about."""
    return F.rlike(text, F.lit(NOTICE_LINE))


def masked_page(text: Column) -> Column:
    """A page without what differs between copies of one notice: ids, numbers and paths; stack frames as one, however many."""
    page = F.regexp_replace(text, r"^[\s　]+|[\s　]+$", "")
    framed = F.regexp_replace(page, r"(?:\n\s*(?:at \S+\([^\n]*|File \"[^\n]*))+", "\n@")
    return F.regexp_replace(F.regexp_replace(framed, r"/[\w./-]+", "/"), r"[0-9a-fA-F]*\d[0-9a-fA-F]*", "#")


def _points(text: str):
    """Code points of the text between two line ends."""
    import numpy as np

    return np.frombuffer(f"\n{text}\n".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def _numbers_masked(points):
    """(points, kept): every number as one '#', and which of the given points are kept."""
    import numpy as np

    digit = (points >= 48) & (points <= 57)
    inner = np.zeros(len(points), dtype=bool)
    inner[1:-1] = ((points[1:-1] == 46) | (points[1:-1] == 44)) & digit[:-2] & digit[2:]
    number = digit | inner
    kept = ~number
    kept[1:] |= ~number[:-1]
    kept[:1] = True
    return np.where(number, 35, points)[kept].astype(np.uint64), kept


def _anchors(points):
    """(before, after): at every place between points, a hash of the characters on each side, as far as the line goes."""
    import numpy as np

    n = len(points)
    padded = np.concatenate([np.full(ANCHOR, 10, np.uint64), points, np.full(ANCHOR, 10, np.uint64)])
    sides = []
    for side in (0, 1):
        value = np.full(n + 1, 7 + side, dtype=np.uint64)
        ended = np.zeros(n + 1, dtype=bool)
        for k in range(ANCHOR):
            at = ANCHOR + k if side else ANCHOR - 1 - k
            char = np.where(ended, np.uint64(0), padded[at : at + n + 1] + np.uint64(1))
            value = (value ^ char) * np.uint64(0x9E3779B97F4A7C15)
            value ^= value >> np.uint64(29)
            ended |= char == 11
        sides.append(value)
    return sides


def places(rows: DataFrame) -> DataFrame:
    """(id, before, after, line): where each candidate row holds residue, by its anchors; line: it fills whole lines.

    rows: (id, text).  Residues that touch each other are one place.
    """
    def run(batches):
        import numpy as np
        import pyarrow as pa

        # a default's label belongs to its place
        form = re.compile("(?a)" + "|".join((FIELD, r"(?:[^\s，。；：:、]{1,8}(?=[：:]))?(?:[：:]\s?)?" + PLACED_DEFAULT, LATIN_RUN, REPEATS)))
        notice = re.compile("(?a)" + NOTICE_LINE)
        between = re.compile(r"[\s、，,。.;；:：\-（）()]*")
        for batch in batches:
            at, before, after = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                spans = sorted([m.span() for m in form.finditer(text)] + [(m.end() - len(m.group().lstrip("\n。！？!?. \t　")), m.end()) for m in notice.finditer(text)])
                joined: list[list[int]] = []
                for a, b in spans:
                    if joined and (a <= joined[-1][1] or ("\n" not in text[joined[-1][1] : a] and between.fullmatch(text, joined[-1][1], a))):
                        joined[-1][1] = max(b, joined[-1][1])
                    else:
                        joined.append([a, b])
                if not joined:
                    continue
                points, kept = _numbers_masked(_points(text))
                left, right = _anchors(points)
                place = np.concatenate([[0], np.cumsum(kept)])
                for a, b in joined:
                    # one line end stands before the text
                    l, r = int(place[a + 1]), int(place[b + 1])  # noqa: E741
                    # an end of a line alone says nothing
                    at.append(i)
                    before.append(None if points[l - 1] == 10 else int(left.view(np.int64)[l]))
                    after.append(None if points[r] == 10 else int(right.view(np.int64)[r]))
            line = [b is None and a is None for b, a in zip(before, after)]
            sides = [pa.array(v, pa.int64()) for v in (before, after)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *sides, pa.array(line, pa.bool_())], names=["id", "before", "after", "line"])

    return rows.select("id", "text").mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, before bigint, after bigint, line boolean")


def open_anchors(df: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(anchor): those of the wanted ones beside which the texts hold at least ``SHARED`` different values.

    All texts are read once.  A bitmap of the wanted anchors, of fixed size, tells which places matter;
    of each anchor a batch passes on at most ``SHARED`` different values, as more say nothing more.
    """
    import numpy as np

    spark = df.sparkSession
    bit = F.pmod("anchor", F.lit(BITS))
    words = wanted.groupBy(F.floor(bit / 64).cast("int").alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (bit % 64).cast("int"))).alias("bits")).collect()
    bitmap = np.zeros(BITS // 64, dtype=np.uint64)
    if words:
        bitmap[[w["word"] for w in words]] = np.array([w["bits"] for w in words], dtype=np.int64).view(np.uint64)
    shared = spark.sparkContext.broadcast(bitmap)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known = shared.value
        for batch in batches:
            points, _ = _numbers_masked(_points("\n\n".join(t for t in batch.column(0).to_pylist() if t)))
            anchors, values = [], []
            padded = np.concatenate([np.full(2, 10, np.uint64), points, np.full(2, 10, np.uint64)])
            pair = (padded[:-1] << np.uint64(21)) | padded[1:]
            for side, own in enumerate(_anchors(points)):
                at = own & np.uint64(BITS - 1)
                hit = np.flatnonzero((known[at >> np.uint64(6)] >> (at & np.uint64(63))) & np.uint64(1))
                anchors.append(own[hit])
                # two characters beyond the place on the other side
                values.append(pair[hit + 2] if not side else pair[hit])
            anchor, value = np.concatenate(anchors), np.concatenate(values)
            order = np.lexsort((value, anchor))
            anchor, value = anchor[order], value[order]
            new = np.ones(len(anchor), dtype=bool)
            new[1:] = (anchor[1:] != anchor[:-1]) | (value[1:] != value[:-1])
            anchor, value = anchor[new], value[new]
            first = np.searchsorted(anchor, anchor)
            few = np.arange(len(anchor)) - first < SHARED
            yield pa.RecordBatch.from_arrays([pa.array(anchor[few].view(np.int64)), pa.array(value[few].view(np.int64))], names=["anchor", "value"])

    met = df.select(text_col).mapInArrow(run, "anchor bigint, value bigint")
    return met.groupBy("anchor").agg(F.count_distinct("value").alias("n")).where(F.col("n") >= SHARED).select("anchor")


def masked(text: Column) -> Column:
    return F.regexp_replace(text, r"[0-9]+(?:[.,][0-9]+)*", "#")


def clauses(text: Column) -> Column:
    """The clauses of a text."""
    return F.filter(F.transform(F.split(text, r"[，。；;！!？?\n]|,(?![0-9])"), F.trim), lambda c: F.length(c) >= ENDS + 1)


def clause_slots(text: Column) -> Column:
    """(left, right) of every place in a clause that holds what a slot may keep, neither quoted nor spoken about."""
    held = F.filter(F.transform(clauses(text), masked), lambda c: F.rlike(c, F.lit(QUOTED_BEFORE + LOOSE + QUOTED_AFTER)))
    left = lambda c: F.regexp_extract(c, "^(.*?)" + QUOTED_BEFORE + LOOSE + QUOTED_AFTER, 1)
    right = lambda c: F.regexp_extract(c, "^.*?" + QUOTED_BEFORE + LOOSE + QUOTED_AFTER + "(.*)$", 1)
    return F.transform(held, lambda c: F.struct(left(c).alias("left"), right(c).alias("right")))


def aligned_slots(df: DataFrame, text_col: str, wanted: DataFrame) -> DataFrame:
    """(left, right) of the places among ``wanted`` that clauses of the corpus fill in at least ``SHARED`` ways.

    A clause is aligned if it has the same start up to the place and goes on alike after it, or the
    same end and comes to it alike; what stands between is the fill.
    """
    ends = lambda c: F.array(F.concat(F.lit("<"), F.substring(c, 1, ENDS)), F.concat(F.lit(">"), F.right(c, F.lit(ENDS))))
    one = wanted.select("left", "right").distinct()
    by_start = one.where(F.length("left") >= ENDS).select("left", "right", F.concat(F.lit("<"), F.substring("left", 1, ENDS)).alias("key"))
    by_end = one.where(F.length("right") >= ENDS).select("left", "right", F.concat(F.lit(">"), F.right("right", F.lit(ENDS))).alias("key"))
    places = materialise(by_start.unionByName(by_end), "places")
    corpus = df.select(F.explode(clauses(F.col(text_col))).alias("raw")).select(masked(F.col("raw")).alias("clause"), F.xxhash64("raw").alias("raw"))
    met = corpus.select("clause", "raw", F.explode(ends(F.col("clause"))).alias("key")).join(places, "key").select("left", "right", "clause", "raw", F.substring("key", 1, 1).alias("side"))
    after, before = F.substring("right", 1, FAR_SIDE), F.right("left", F.lit(FAR_SIDE))
    rest = F.expr("substring(clause, length(left) + 1)")
    lead = F.expr("substring(clause, 1, length(clause) - length(right))")
    cut = F.when(after == "", rest).when(F.instr(rest, after) > 1, F.call_function("substring_index", rest, after, F.lit(1)))
    tail = F.when(before == "", lead).when(F.instr(lead, before) > 0, F.call_function("substring_index", lead, before, F.lit(-1)))
    fill = F.when((F.col("side") == "<") & F.startswith("clause", F.col("left")), cut).when((F.col("side") == ">") & F.endswith("clause", F.col("right")), tail)
    # in Latin script a place within a sentence whose fills are words of it is none: values are names or numbers
    latin = F.rlike("left", F.lit("[A-Za-z] ?$")) | F.rlike("right", F.lit("^ ?[a-z]"))
    value = ~F.rlike("fill", F.lit(LOOSE)) & F.when(latin, (F.trim("left") != "") & F.rlike("fill", F.lit("^[A-Z0-9#]"))).otherwise(True)
    filled = met.select("left", "right", F.trim(fill).alias("fill"), "raw").where((F.length("fill") > 0) & (F.length("fill") <= FILL_CHARS) & value)
    # values that hold numbers differ if their numbers do
    ways = F.struct("fill", F.when(F.contains("fill", F.lit("#")), F.col("raw")).alias("raw"))
    return filled.groupBy("left", "right").agg(F.count_distinct(ways).alias("ways")).where(F.col("ways") >= SHARED).select("left", "right")


def _sentences(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"[。！？!?\n]+"), F.trim), lambda x: F.length(x) >= FILLER_CHARS)


def filler_sentences(rows: DataFrame, filler: DataFrame) -> DataFrame:
    """(id): rows that hold a sentence of the filler texts; both of (id, text).

    A sentence is learned if it follows at least ``SHARED`` different ones in filler texts (copies of one
    text say nothing) and at least half of the texts that hold it are filler texts.
    """
    cut = filler.select(_sentences(F.col("text")).alias("all"))
    parts = cut.select("all", F.posexplode("all").alias("at", "s"))
    before = F.when(F.col("at") > 0, F.element_at("all", F.col("at"))).otherwise("")
    learned = parts.groupBy(F.xxhash64("s").alias("s")).agg(F.count_distinct(F.xxhash64(before)).alias("n")).where(F.col("n") >= SHARED).select("s")
    learned = materialise(learned, "sentences")
    held = rows.select("id", F.explode(F.transform(_sentences(F.col("text")), lambda x: F.xxhash64(x))).alias("s")).join(learned, "s", "left_semi").distinct()
    known = filler.select("id", F.lit(1).alias("filler")).distinct()
    held = materialise(held.join(known, "id", "left"), "held")
    kept = held.groupBy("s").agg(F.count(F.lit(1)).alias("n"), F.count("filler").alias("f")).where("2 * f >= n").select("s")
    return held.where("filler IS NULL").join(kept, "s", "left_semi").select("id").distinct()


def residue(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", forms: bool = True) -> DataFrame:
    """(id, kind, way): every row that is or holds residue.

    kind: notice, field, default or filler; way: what showed it (slot, line, page or form).  Without
    ``forms``, only what other records show.
    """
    read = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.rlike(text_col, F.lit(r"\S")))
    text = F.col("text")
    kind = F.when(notice_page(text), "page").when(holds_notice(text), "notice").when(holds_field(text), "field").when(holds_default(text), "default").when(holds_filler(text), "filler")
    # exploding an array of one keeps the costly expression from being copied into every use of it
    once = read.select("id", "text", F.explode(F.array(kind)).alias("kind"))
    # a plainer test first, as most texts keep nothing of the kind
    loose = F.rlike(text, F.lit("(?=[nuNX×oa-z0-9])(?:null|undefined|NaN|None|N/A|XX|××|object Object|[a-z0-9]_[a-z0-9]|[a-z][A-Z])")) & F.rlike(text, F.lit(LOOSE))
    judged = once.select("id", "kind", "text", F.when(F.col("kind").isNull() & loose, clause_slots(text)).alias("loose"))
    # of a page only its masked form is needed later, of other rows the text
    kept = judged.where("kind IS NOT NULL OR size(loose) > 0").select("id", "kind", F.when(F.col("kind") == "page", masked_page(text)).when(F.col("kind").isNotNull(), text).alias("text"), "loose")
    candidates = materialise(kept, "residue")
    pages = candidates.where("kind = 'page'")
    repeated = pages.groupBy("text").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= SHARED).select("text")
    found = pages.join(repeated.withColumn("again", F.lit(True)), "text", "left").select("id", F.lit("notice").alias("kind"), F.when(F.col("again"), "page").otherwise("form").alias("way"))
    marked = candidates.where("kind != 'page'")
    placed = materialise(places(marked), "anchors")
    if not placed.isEmpty():
        sides = placed.where("NOT line").select("id", F.explode(F.array_compact(F.array("before", "after"))).alias("anchor"))
        aligned = sides.join(open_anchors(read, "text", sides.select("anchor").distinct()), "anchor", "left_semi")
        ways = aligned.select("id", F.lit(1).alias("w")).unionByName(placed.where("line").select("id", F.lit(2).alias("w"))).groupBy("id").agg(F.min("w").alias("w"))
        found = found.unionByName(marked.select("id", "kind").join(ways, "id", "left").select("id", "kind", F.when(F.col("w") == 1, "slot").when(F.col("w") == 2, "line").otherwise("form").alias("way")))
    else:
        found = found.unionByName(marked.select("id", "kind", F.lit("form").alias("way")))
    held = candidates.where("size(loose) > 0").select("id", F.explode("loose").alias("p")).select("id", "p.left", "p.right")
    if not held.isEmpty():
        slots = aligned_slots(read, "text", held)
        found = found.unionByName(held.join(slots, ["left", "right"], "left_semi").select("id", F.lit("default").alias("kind"), F.lit("slot").alias("way")))
    fillers = candidates.where("kind = 'filler'").select("id", "text")
    if not fillers.isEmpty():
        found = found.unionByName(filler_sentences(read, fillers).select("id", F.lit("filler").alias("kind"), F.lit("slot").alias("way")))
    shown = found if forms else found.where("way != 'form'")
    # a repeated id keeps one row: the first by kind and way
    return shown.groupBy("id").agg(F.min(F.struct("kind", "way")).alias("k")).select(F.col("id").alias(id_col), "k.kind", "k.way")
