from conftest import rows
from loomwright.llm import residue

MARKED = {
    "field": ["合格率为{{rate}}，已公布。", "由${unitName}负责。", "第$!{docNo}号", "共{%n%}户", "见<%= title %>", "[[单位名称]]负责", "在@@area@@召开", "由__单位名称__签发", "经%项目名称%核定", "按{content}办理", "{ MERGEFIELD 文号 }号", '<c:out value="x"/>',
              "单位：【请在此处填写单位名称】", "<请输入正文>", "[项目概况待补充]", "XXXX（发布日期，发布前替换）", "（此处插入数据来源）", "Dear [insert name here], hello"],
    "default": ["联系人：null，电话：undefined。", "截至NaN年NaN月，", "根据[object Object]，", "标题:None\n来源:{}", "文号：null-undefined"],
    "filler": ["Lorem ipsum dolor sit amet consectetur.", "样稿样稿样稿正文", "asdf asdf asdf", "输入您的文字输入您的文字", "啊啊啊啊啊啊"],
    "notice": ["404 Not Found\nnginx/1.2", "系统维护中，预计8点恢复。", "Please enable JavaScript to view this page.", "您的浏览器未启用JavaScript，请开启后刷新页面。", "Traceback (most recent call last):\n  File \"a.py\", line 3, in f\nKeyError: 'x'",
               "java.lang.NullPointerException\n\tat a.b.c(D.java:1)", "抱歉，您访问的页面不存在\n5秒后自动返回首页", "请输入验证码以继续访问", "Access denied. Ray 5f"],
}
CLEAN = [
    "凡以双花括号标出的字段，例如“{{单位名称}}”，由系统自动替换。", "培训讲义介绍了 ${变量} 写法与脚本禁用后的提示语。", "备注栏不得填写null或undefined，否则退回。", "系统上线首日有用户反映页面提示“请启用JavaScript”，经核实为浏览器版本过低所致。", "集合 {1, 2, 3} 表示编号，[3] 为序号。",
    "C = {a × b} ÷ 3%", "合同空白处（________）由签署方填写。", "“页面不存在”类投诉3件均已答复；登录超时问题另案处理。", "演示文稿中的“lorem ipsum”一类占位文字须删除。", "a null result is reported.", "某某市（隐去名称）事故通报", "数据缺失项以“--”或“N/A”表示。", "<|endoftext|>", "", " 　\n", None,
    "占比由5%升至10%，其中3%为新增。", "The report can be read without JavaScript.", "2025年3月平台维护4次，期间暂停申报，现已全部恢复。", "None of the sites reported a gap.", "正文" * 2,
]


def test_kinds(spark):
    data = [(i, t, k) for i, (k, t) in enumerate((k, t) for k, own in MARKED.items() for t in own)]
    out = {i: k for i, k, _ in rows(residue.residue(spark.createDataFrame(data, "doc_id long, text string, kind string")))}
    assert {t: out.get(i) for i, t, _ in data} == {t: k for _, t, k in data}


def test_clean_texts(spark):
    df = spark.createDataFrame(list(enumerate(CLEAN)), "doc_id long, text string")
    assert [CLEAN[i] for i, *_ in rows(residue.residue(df))] == []
    assert rows(residue.residue(df.limit(0))) == []


def test_residue_within_long_text_and_repeats(spark):
    long = "充放电曲线由属地供电所及时确认。" * 5000
    df = spark.createDataFrame([(1, long), (2, long + "{{x}}"), (2, long + "{{x}}"), (3, "{{y}}" + long)], "doc_id long, text string")
    assert {i for i, *_ in rows(residue.residue(df))} == {2, 3}


def test_slots_are_induced_from_aligned_records(spark):
    filled = [(i, f"计划投入{i * 7}万元用于改造。") for i in range(10)]
    odd = [(100, "计划投入N/A万元用于改造。"), (101, "标记N/A表示缺失的数据。")]
    df = spark.createDataFrame([*filled, *odd], "doc_id long, text string")
    assert [r[0] for r in rows(residue.residue(df))] == [100]


def test_slots_with_any_fill_are_aligned(spark):
    names = ["岚渡市", "芷溪州", "澜陵市工业局", "皓塬州"]
    filled = [(i, f"本项目由{n}负责实施，总投资{i}万元。联系单位：{n}服务窗口\nThe permit was issued by {e} on 3 May.") for i, (n, e) in enumerate(zip(names, ["Ann Lee", "Bo Ray", "Cy Fox", "Di Orr"]))]
    prose = [(50 + i, f"Readers follow the glossary; a {w} result is reported twice.") for i, w in enumerate(["good", "partial", "complete", "late"])]
    odd = [(100, "本项目由N/A负责实施，总投资7万元。"), (101, "本项目由None负责实施，另行通知。"), (102, "联系单位：unit_name服务窗口"), (103, "The permit was issued by None on 3 May.")]
    clean = [(200, "Readers follow the glossary; a null result is reported twice."), (201, "本项目由“N/A”负责实施的写法应更正。"), (202, "备注栏不得填写null或undefined，否则退回。")]
    df = spark.createDataFrame([*filled, *prose, *odd, *clean], "doc_id long, text string")
    assert rows(residue.residue(df)) == [(i, "default", "slot") for i in (100, 101, 102, 103)]


def test_notices_within_texts_of_any_length(spark):
    body = "充放电曲线由属地供电所及时确认，偏差超过3%的计入考核。\n" * 40
    frames = "\n".join(f"  File \"/srv/app/module_{i}.py\", line {i}, in handle" for i in range(60))
    held = [
        body + "Please enable JavaScript to view this page.", "请启用JavaScript以继续浏览。\n" + body, body + "您访问的页面不存在\n" + body, "The plan was filed. Your session has expired. Staff keep records.",
        body + "系统维护中，预计8点恢复。", body + "该内容需登录后查看", "Traceback (most recent call last):\n" + frames + "\nKeyError: 'x'", "502 Bad Gateway\n" + "nginx/1.2\n" * 200, body + "java.lang.NullPointerException\n\tat a.b.C(D.java:1)",
    ]
    clean = [
        body + "系统维护中发现的问题另案处理。", body + "请登录后在系统内填报申请表。", body + "平台升级改造，由信息中心负责。", body + "登录超时问题已修复。", body + "“您访问的页面不存在”一类提示语应删除。", body + "Access denied events rose by 3 in May.",
        body + "页面不存在的情况由运维单位登记。", "Sign in to the portal before 5 May. " * 40, body + "提示“请启用JavaScript”，经核实为版本过低。", "Staff filed the plan. Users reported that the page could not be found.",
    ]
    df = spark.createDataFrame([*enumerate(held), *((100 + i, t) for i, t in enumerate(clean))], "doc_id long, text string")
    assert [r[:2] for r in rows(residue.residue(df))] == [(i, "notice") for i in range(len(held))]


def test_ways(spark):
    """Places are shown by other records, whole pages by their copies; what nothing shows is left to its form."""
    orgs = ["岚渡市", "芷溪州", "澜陵市", "皓塬州"]
    data = [(i, f"登记由{o}办理，期限{i}日。") for i, o in enumerate(orgs)]
    data += [(10, "登记由{{unit}}办理，期限3日。"), (11, "孤句{{x}}别无"), (12, "${a}\n{{b}}"), *[(20 + i, f"404 Not Found\nnginx/1.{i}") for i in range(3)], (30, "Access denied. Ray 5f"), (31, "登记由样稿样稿样稿办理")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {i: w for i, _, w in rows(residue.residue(df))} == {10: "slot", 11: "form", 12: "line", 20: "page", 21: "page", 22: "page", 30: "form", 31: "slot"}
    assert {i for i, *_ in rows(residue.residue(df, forms=False))} == {10, 12, 20, 21, 22, 31}


def test_sentences_among_filler_are_learned(spark):
    unit, real = "此段仅作版面示意，发布时换掉。", "各地应当按期报送。"
    data = [(i, f"{c}地已经报送完毕。{unit}啊啊啊啊啊啊") for i, c in enumerate("甲乙丙丁戊己")]
    # copies of one text with filler teach nothing about its sentences
    data += [(20 + i, f"{real}样稿样稿样稿。") for i in range(4)]
    data += [(40, f"戌地办结。{unit}"), (41, f"{real}亥地办结。"), (42, "")]
    df = spark.createDataFrame(data, "doc_id long, text string")
    assert {i for i, *_ in rows(residue.residue(df))} == {0, 1, 2, 3, 4, 5, 20, 21, 22, 23, 40}


def test_open_anchors_equal_brute_force(spark):
    import random

    rng = random.Random(5)
    texts = ["".join(rng.choice("ab1。\n") for _ in range(rng.randint(0, 60))) for _ in range(60)] + ["", "9.5", "𠮷" * 9]
    beside: dict[int, set] = {}
    for t in texts:
        points, _ = residue._numbers_masked(residue._points(t))
        padded = [10, 10, *points.tolist(), 10, 10]
        for side, own in enumerate(residue._anchors(points)):
            for at, anchor in enumerate(own.view("int64").tolist()):
                if padded[at + 2 if side else at + 1] != 10:
                    beside.setdefault(anchor, set()).add(tuple(padded[at : at + 2] if side else padded[at + 2 : at + 4]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    wanted = spark.createDataFrame([(a,) for a in beside], "anchor long")
    assert {r[0] for r in rows(residue.open_anchors(df, "text", wanted))} == {a for a, v in beside.items() if len(v) >= residue.SHARED}
