"""Page boilerplate: which lines of a page belong to the site, and the body without them.

Template deduction after equivalence classes, with masked lines as tokens.  The occurrence vector of
a token says how often each page of one host holds it, kept as a count and an additive hash, so it is
built by one partially aggregated shuffle however many pages a host has.

* Tokens of one host with the same vector form a class.  A class of several tokens on enough pages is
  valid if its tokens follow each other in one order on every page, and if it does not interleave with
  a class on more pages: all of it lies in one and the same gap of the other, or the other way round.
* The host's template is its valid classes together with tokens that stay on few hosts where chance
  would spread them over many.
* What lies between two tokens of the template, or between one and an end of the page, is a slot of
  the host.  The body is what fills the page's largest run; a slot that never holds it on enough pages
  is the site's, whatever fills it (breadcrumbs, dates, entries of lists).
* Lines that fill slots in many ways (list headings and entries, links to the next page, tools) are
  known by the slots they fill: a kind of line that lies outside the largest run on ``SLOT_SHARE`` of
  its pages is the site's wherever it stands, also amid the body; what policies say lies in the largest
  run always.  Kinds are the masked line; its start and shape where lines of its own are too few; its
  shape alone where those are too few.  The finest kind with enough pages decides (``slot_kinds``).
* A rest too rare for either (3 % of the lines at sf0.1) is left to stated forms: navigation, breadcrumbs,
  tools, notices, footers, and list headings with the entries that follow them without a break.
  ``forms=False`` leaves it out.

All other lines are the remaining slots: the body.

Copies of one page must not look like a template, so vectors count ids, not rows, and a valid class
needs ``LEAST_PAGES`` of them, or half of a smaller host's and less than half of what stands on them; recurring sentences of policies ("hereby notified") are single tokens
spread over all hosts and stay in the body.

Defined results: null and empty texts have no lines; blank lines are never the site's; a page without
a host is a page of the host ''; repeated rows are each cleaned; an empty table gives an empty
result; other columns are not read.  Lines are split at '\\n' alone and counted from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from loomwright.session import materialise

#: Ids on which a class, a slot or a host's own token must stand.
LEAST_PAGES = 12
#: On hosts with few ids a class must stand on half of them, and on this many.
LEAST_OF_FEW = 3
#: Share of its pages on which a kind of line must lie outside the largest run.
SLOT_SHARE = 0.03
#: Characters of a line's start that tell kinds of one shape apart.
START_CHARS = 3
#: A token is a host's own if it is seen on less than this share of the hosts chance would give it.
OWN_SHARE = 0.6
#: Longest line, in characters, whose form is looked at; longer ones are the site's by the template, or
#: if they are nothing but entries of navigation bars.
LINE_CHARS = 200

# Entries of navigation bars.
NAVIGATION = (
    "首页 网站首页 机构职能 机构概况 办事服务 在线服务 专题专栏 新闻动态 新闻中心 政策文件 政策法规 数据发布 数据开放 党建园地 监督举报 人事信息 规划计划 通知公告 政务公开 互动交流 "
    "政民互动 公众参与 图片新闻 信用能源 信息公开 政府信息公开 联系我们 关于我们 网站地图 法律声明 版权声明 隐私声明 隐私政策 使用帮助 无障碍 无障碍浏览 English Home Contact Sitemap Login"
).split()
# Headings of lists of other pages.
HEADINGS = (
    "延伸阅读 相关阅读 相关链接 相关文章 相关新闻 相关信息 相关推荐 相关稿件 猜你想看 猜你喜欢 热点推荐 热门推荐 热门文章 推荐阅读 为您推荐 栏目最新 最新文章 最新发布 点击排行 阅读排行 热门排行 "
    "本周热点 更多推荐 编辑推荐"
).split()
# Forms of page furniture, whole lines.
FORMS = [
    r"(?:当前|所在|您(?:当前|现在)?的|你的)位置.*",
    r"(?:网站)?首页\s*(?:>|/|→|»|-|·|\|).*",
    r"(?:您好[，,])?欢迎(?:访问|来到|光临).*(?:网|门户).*",
    r"今日天气.*",
    r".*无障碍浏览.*",
    r"字[体号][：:].*",
    r"(?:浏览|阅读|访问|点击)(?:次数|量)?[：: ]*\d+ ?次?(?:\s.*|[｜|].*|$)",
    r".*【(?:打印|关闭|关闭窗口|收藏)】.*",
    r"分享(?:到|至)[：: ].*",
    r"(?:扫一扫|微信扫码|扫码(?:分享|关注)).{0,20}",
    r"[上下]一(?:篇|条|页)(?:[：: ]|$).*",
    r"(?:打印 )?(?:关闭 )?(?:返回顶部|回到顶部|返回首页|加载更多|点击展开|展开菜单|展开全文|收起).{0,12}",
    r"第\d+页 共\d+页.*|.*上一页 下一页.*",
    r"评论（\d+）.*|点赞 ?\d+.*|.*发表评论.{0,8}登录.*",
    r"您觉得本页.*",
    r"RSS订阅.*|(?:下载|打印|收藏)本页.*|适老版.*|请输入关键[词字].*|简体中文 \|.*|.*繁體 \|.*",
    r"注册 \|.*|登录 \|.*|>>> ?登录.*",
    r"【广告】.*|(?:热搜词?|热门搜索|搜索热词|热门标签)[：:].*",
    r"(?:本(?:网)?站|我们会?在您|为向您提供|隐私提示|(?:This|Our) (?:web)?site|We (?:use|value)|By (?:continuing|browsing)).*(?:[Cc]ookies?|文本记录|记录访问|信息收集|访问偏好).*",
    r"(?:Skip to|Back to top|Jump to|Share this|Print this|Related (?:articles|posts|links)|Read more|Subscribe to|Sign in \||Log in \|).{0,80}",
    r"Copyright .*|©.*|版权所有.*|.*版权所有 .*|.{2,20}版权所有",
    r".*ICP备.*|.*网安备.*",
    r"网站标识码[：:].*|主办单位[：:].*|主管单位[：:].*|承办单位[：:].*|技术支持[：:].*|友情链接[：:].*",
    r"建议使用.{0,30}(?:分辨率|浏览器).*",
]
ENTRIES = [
    r"\d{1,2}[ .、].{2,60}（\d+次）",
    r"(?:▪|·|•|■|◆|>>|»|-) ?[^。；]{4,60}",
    r"[^。；]{4,60}(?:  |\t| )?[\[（(]?(?:\d{4}-)?\d{1,2}-\d{1,2}[\]）)]?",
]


def host_of(url: Column) -> Column:
    """Host of a URL in lower case; '' where there is none."""
    return F.coalesce(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def _whole(patterns: list[str]) -> str:
    return "^(?:" + "|".join(patterns) + r")\s*$"


def page_lines(pages: DataFrame, row_id: str, page_id: str, url: str, text: str) -> DataFrame:
    """(row, page, host, line_no, token, start, shape, marked, kind, chars): every line that is not blank.

    token: the line, numbers masked; shape: the same, words masked; start: its first characters and its
    shape; marked: whether the shape has signs that tell it from a plain line or a label with its value.
    kind: form (furniture anywhere), heading (opens a list), entry (of the form of list entries), ''.
    chars: length of the line.
    """
    navigation = r"(?:" + "|".join(NAVIGATION) + ")"
    separated = navigation + r"(?:[\s　·|/>→-]+" + navigation + r")*"
    headings = r"(?:" + "|".join(HEADINGS) + r")[：:]?|Related (?:articles|posts|links)|Popular|Most read"
    read = pages.where(F.col(text).isNotNull() & (F.col(text) != "")).select(
        F.col(row_id).alias("row"), F.xxhash64(F.col(page_id)).alias("page"), host_of(F.col(url)).alias("host"), F.posexplode(F.split(F.col(text), "\n", -1)).alias("at", "line")
    )
    line = F.trim(F.regexp_replace("line", r"^[\s　]+|[\s　]+$", ""))
    short = F.length("line") <= LINE_CHARS
    # without a repeated group, as a line may be of any length
    entries = r"(?:" + "|".join(sorted(NAVIGATION, key=len, reverse=True)) + r")(?=[\s　·|/>→-]|$)|[\s　·|/>→-]+"
    bar = F.rlike("line", F.lit("^" + navigation + r"[\s　·|/>→-]")) & (F.regexp_replace("line", entries, "") == "")
    kind = (
        F.when(~short, F.when(bar, "form").otherwise(""))
        .when(F.rlike("line", F.lit(_whole([headings]))), "heading")
        .when(F.rlike("line", F.lit(_whole([separated, *FORMS]))), "form")
        .when(F.rlike("line", F.lit(_whole(ENTRIES))), "entry")
        .otherwise("")
    )
    kept = read.withColumn("line", line).where("line != ''").withColumn("masked", F.regexp_replace("line", r"[0-9]+", "#"))
    shaped = kept.withColumn("shape", F.regexp_replace("masked", r"\p{L}+", "x"))
    return shaped.select(
        "row", "page", "host", (F.col("at") + 1).cast("long").alias("line_no"), F.xxhash64("masked").alias("token"), F.xxhash64(F.substring("masked", 1, START_CHARS), "shape").alias("start"),
        F.xxhash64("shape").alias("shape"), F.rlike("shape", F.lit("[^x#：: ]")).alias("marked"), kind.alias("kind"), F.length("line").alias("chars"),
    )


def valid_classes(lines: DataFrame, classes: DataFrame) -> DataFrame:
    """(host, token) of the classes that are ordered and nested; classes: (host, class, pages, tokens)."""
    tokens = classes.select("host", "class", "pages", F.size("tokens").alias("size"), F.explode("tokens").alias("token"))
    # the first place of every token of a class on each row
    found = lines.join(tokens, ["host", "token"]).groupBy("host", "class", "pages", "size", "row", "token").agg(F.min("line_no").alias("at"))
    placed = materialise(found.groupBy("host", "class", "pages", "size", "row").agg(F.sort_array(F.collect_list(F.struct("at", "token"))).alias("places")), "places")
    # rows of a page that hold a part of the class say nothing about its order
    whole = placed.where(F.size("places") == F.col("size"))
    ordered = whole.groupBy("host", "class").agg(F.count_distinct(F.xxhash64("places.token")).alias("orders")).where("orders = 1").select("host", "class")
    held = whole.join(ordered, ["host", "class"], "left_semi").select("host", "class", "pages", "row", F.col("places.at").alias("at"))
    one, other = (held.select("host", "row", *[F.col(c).alias(f"{c}_{n}") for c in ("class", "pages", "at")]) for n in "ab")
    gap = lambda inner, outer, end: F.size(F.filter(F.col(outer), lambda p: p < (F.array_min(inner) if end == "first" else F.array_max(inner))))
    both = one.join(other, ["host", "row"]).where("pages_a > pages_b OR (pages_a = pages_b AND class_a < class_b)")
    gaps = both.select("host", "class_a", "class_b", *[gap(f"at_{i}", f"at_{o}", end).alias(f"{end}_{i}") for i, o in ("ba", "ab") for end in ("first", "last")])
    one_gap = lambda i: F.min(f"first_{i}") == F.max(f"last_{i}")
    crossing = gaps.groupBy("host", "class_a", "class_b").agg((one_gap("a") | one_gap("b")).alias("nested")).where("NOT nested").select("host", F.col("class_b").alias("class")).distinct()
    return tokens.join(ordered, ["host", "class"], "left_semi").join(crossing, ["host", "class"], "left_anti").select("host", "token")


def template_tokens(lines: DataFrame) -> DataFrame:
    """(host, token): tokens of each host's template, by occurrence vectors alone."""
    once = lines.groupBy("host", "token", "page").agg(F.count(F.lit(1)).alias("times"))
    once = once.select("host", "token", F.xxhash64("page", "times").alias("mark"))
    vectors = once.groupBy("host", "token").agg(F.count(F.lit(1)).alias("pages"), F.sum(F.shiftrightunsigned("mark", 32)).alias("high"), F.sum(F.col("mark").bitwiseAND(F.lit(0xFFFFFFFF))).alias("low"))
    # all hosts of every token that is common on some host
    frequent = once.groupBy("token").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min(LEAST_PAGES, LEAST_OF_FEW)).select("token")
    vectors = materialise(vectors.join(frequent, "token", "left_semi"), "vectors")
    common = vectors.where(F.col("pages") >= LEAST_PAGES)
    # classes: several tokens equally often on exactly the same pages
    ids = lines.groupBy("host").agg(F.count_distinct("page").alias("ids"))
    least = F.least(F.lit(LEAST_PAGES), F.greatest(F.lit(LEAST_OF_FEW), F.ceil(F.col("ids") / 2)))
    alike = vectors.join(ids, "host").where(F.col("pages") >= least).groupBy("host", "pages", "high", "low").agg(F.collect_set("token").alias("tokens")).where(F.size("tokens") > 1)
    alike = alike.select("host", F.xxhash64("host", "pages", "high", "low").alias("class"), "pages", "tokens")
    few = alike.where(F.col("pages") < LEAST_PAGES).select("host", "class", F.explode("tokens").alias("token"))
    # a few copies of one page share most of it, a template of a small host leaves room for the body
    held = lines.join(few, ["host", "token"]).groupBy("host", "class", "row").agg(F.sum("chars").alias("held"))
    whole = lines.join(few.select("host").distinct(), "host", "left_semi").groupBy("row").agg(F.sum("chars").alias("chars"))
    copied = held.join(whole, "row").groupBy("host", "class").agg(F.sum("held").alias("held"), F.sum("chars").alias("chars")).where("2 * held >= chars").select("host", "class")
    classes = valid_classes(lines, alike.join(copied, ["host", "class"], "left_anti"))
    # tokens that stay on few hosts: chance would put n pages on sum(1 - (1 - share)^n) of them.  Hosts are
    # counted by size in quarter steps of log2, so that what comes to the driver is at most some 200 rows
    sizes = lines.select("host", "row").distinct().groupBy("host").agg(F.count(F.lit(1)).alias("n"))
    steps = sizes.groupBy(F.floor(F.log2("n") * 4).alias("step")).agg(F.count(F.lit(1)).alias("hosts"), F.sum("n").alias("pages")).collect()
    if not steps:
        return classes.distinct()
    total = sum(r["pages"] for r in steps)
    histogram = F.array(*[F.struct(F.lit(float(r["hosts"])).alias("hosts"), F.lit(1 - r["pages"] / r["hosts"] / total).alias("miss")) for r in steps])
    expected = F.aggregate(histogram, F.lit(0.0), lambda so, s: so + s["hosts"] * (1 - F.pow(s["miss"], F.col("pages"))))
    seen = vectors.groupBy("token").agg(F.sum("pages").alias("pages"), F.count(F.lit(1)).alias("hosts"))
    own = seen.where(F.col("hosts") < OWN_SHARE * expected).select("token")
    return classes.unionByName(common.join(own, "token", "left_semi").select("host", "token")).distinct()


def in_runs(lines: DataFrame) -> DataFrame:
    """The lines with ``run`` and ``outside``.

    A run begins with its template token and ends before the next one; outside: the line is none of the
    template and its run is not the largest of a page that holds template tokens.
    """
    page = W.partitionBy("row")
    placed = lines.withColumn("run", F.sum(F.col("nested").cast("int")).over(page.orderBy("line_no")))
    sized = placed.withColumn("held", F.sum(F.when(~F.col("nested"), F.col("chars")).otherwise(0)).over(W.partitionBy("row", "run")))
    outside = ~F.col("nested") & (F.col("held") < F.max("held").over(page)) & F.max("nested").over(page)
    return sized.withColumn("outside", outside).drop("held")


def slot_lines(placed: DataFrame) -> DataFrame:
    """(row, line_no) of the lines in slots of the template that never hold the largest run of a page.

    placed: lines with ``nested``, ``run`` and ``outside``.
    """
    before = F.max(F.when(F.col("nested"), F.col("token"))).alias("before")
    runs = placed.groupBy("row", "run", "page", "host").agg(before, F.count_if(~F.col("nested")).alias("lines"), (~F.max("outside")).alias("largest"))
    bounded = runs.withColumn("after", F.lead("before").over(W.partitionBy("row").orderBy("run")))
    filled = materialise(bounded.where("lines > 0 AND (before IS NOT NULL OR after IS NOT NULL)").select("row", "run", "page", "host", F.xxhash64("before", "after", F.isnull("before")).alias("slot"), "largest"), "runs")
    pages = filled.groupBy("host", "slot", "page").agg(F.max("largest").alias("largest"))
    site = pages.groupBy("host", "slot").agg(F.count(F.lit(1)).alias("pages"), F.max("largest").alias("largest")).where((F.col("pages") >= LEAST_PAGES) & ~F.col("largest")).select("host", "slot")
    return placed.where("NOT nested").join(filled.join(site, ["host", "slot"], "left_semi").select("row", "run"), ["row", "run"], "left_semi").select("row", "line_no")


def slot_kinds(placed: DataFrame) -> DataFrame:
    """(token): lines of the kinds that fill slots of templates; the finest kind on enough pages decides.

    Pages are counted by kind after they were reduced to one row for each line text and page, so a kind
    with a third of all lines is combined before the shuffle, like any other.
    """
    once = placed.where("NOT nested").groupBy("token", "start", "shape", "marked", "page").agg(F.max("outside").alias("outside"))
    counts = [F.count(F.lit(1)).alias("pages"), F.count_if("outside").alias("out")]
    kinds = materialise(once.groupBy("token", "start", "shape", "marked").agg(*counts), "kinds")
    enough, fills = F.col("pages") >= LEAST_PAGES, (F.col("out") >= LEAST_OF_FEW) & (F.col("out") >= SLOT_SHARE * F.col("pages"))
    sums = [F.sum("pages").alias("pages"), F.sum("out").alias("out")]

    def decided(rows: DataFrame, kind: str) -> DataFrame:
        groups = rows.groupBy(kind).agg(*sums).where(enough).select(kind, fills.alias("fills"))
        return rows.join(groups, kind, "left")

    by_start = decided(kinds.where(~enough), "start")
    by_shape = decided(by_start.where("fills IS NULL AND marked").drop("fills"), "shape")
    found = [kinds.where(enough & fills), by_start.where("fills"), by_shape.where("fills")]
    return found[0].select("token").unionByName(found[1].select("token")).unionByName(found[2].select("token"))


def site_lines(pages: DataFrame, row_id: str, page_id: str, url: str, text: str, forms: bool = True) -> DataFrame:
    """(row_id, line_no) of every line that belongs to the site; without ``forms`` by the template alone."""
    lines = materialise(page_lines(pages, row_id, page_id, url, text), "lines")
    template = template_tokens(lines).withColumn("nested", F.lit(True))
    joined = lines.join(template, ["host", "token"], "left").withColumn("nested", F.coalesce("nested", F.lit(False)))
    placed = materialise(in_runs(joined), "placed")
    kinds = placed.where("NOT nested").join(slot_kinds(placed), "token", "left_semi").select("row", "line_no")
    deduced = placed.where("nested").select("row", "line_no").unionByName(slot_lines(placed)).unionByName(kinds)
    if not forms:
        return deduced.distinct().withColumnRenamed("row", row_id)
    marked = placed.select("row", "line_no", "kind", "nested")
    # entries belong to the heading above if nothing but entries stands between
    heads = marked.where("kind = 'heading'").select("row").distinct()
    lists = marked.join(heads, "row", "left_semi")
    order = W.partitionBy("row").orderBy("line_no")
    breaks = F.sum(F.when((F.col("kind") == "entry") & ~F.col("nested"), 0).otherwise(1)).over(order)
    runs = lists.select("row", "line_no", "kind", "nested", breaks.alias("run"))
    opened = F.max(F.when(F.col("kind") == "heading", F.lit(True)).otherwise(F.lit(False))).over(W.partitionBy("row", "run"))
    entries = runs.select("row", "line_no", "kind", "nested", opened.alias("opened")).where("opened AND kind = 'entry'").select("row", "line_no")
    listed = marked.where("kind IN ('form', 'heading')").select("row", "line_no")
    return deduced.unionByName(listed).unionByName(entries).distinct().withColumnRenamed("row", row_id)


def bodies(pages: DataFrame, row_id: str, page_id: str, url: str, text: str) -> DataFrame:
    """(row_id, body): the text of each page without the site's lines."""
    site = site_lines(pages, row_id, page_id, url, text).groupBy(row_id).agg(F.collect_set("line_no").alias("_site"))
    kept = F.filter(F.split(F.col(text), "\n", -1), lambda line, i: ~F.array_contains(F.col("_site"), (i + 1).cast("long")))
    joined = pages.select(row_id, text).join(site, row_id, "left")
    return joined.select(row_id, F.when(F.col("_site").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")).alias("body"))
