from conftest import rows
from loomwright.llm import boilerplate


def pages(spark, extra=()):
    data = []
    for i in range(40):
        host = f"www.h{i % 4}.example"
        body = [f"第{i}条 关于第{i}号事项的说明，由单位{chr(0x4E00 + i * 7)}办理。", "特此通知。" if i % 3 else f"另行通知第{chr(0x4E00 + i)}户。", f"负责人{chr(0x4E00 + i * 13)}"]
        lines = ["首页", "政策文件", f"欢迎您，站点{i % 4}首屏说明", *body, "相关阅读", f"· 某地第{chr(0x5000 + i)}项工程进展", "上一篇：某某情况", f"站点{i % 4}服务承诺书"]
        data.append((i, f"id{i}", f"https://{host}/a/{i}.html", "\n".join(lines), "x"))
    return spark.createDataFrame([*data, *extra], "record_id long, id string, url string, content_text string, host string")


def test_site_lines(spark, monkeypatch):
    monkeypatch.setattr(boilerplate, "LEAST_PAGES", 8)
    found = rows(boilerplate.site_lines(pages(spark), "record_id", "id", "url", "content_text"))
    by = {i: sorted(n for r, n in found if r == i) for i in range(40)}
    # navigation, the host's own two lines (one class), the heading with its entry, the link to the page before
    assert all(v == [1, 2, 3, 7, 8, 9, 10] for v in by.values()), by[0]


def test_bodies_and_edges(spark, monkeypatch):
    monkeypatch.setattr(boilerplate, "LEAST_PAGES", 8)
    extra = [(100, "n", None, None, "x"), (101, "e", "", "", "x"), (102, "b", "https://www.h0.example/", " \n　\n正文第一行写明。", "x"), (103, None, "no url", "首页\n正文" + "长" * 50_000, "x")]
    df = pages(spark, extra)
    out = {r["record_id"]: r["body"] for r in boilerplate.bodies(df, "record_id", "id", "url", "content_text").collect()}
    assert out[1].split("\n")[1] == "特此通知。" and len(out[0].split("\n")) == 3
    assert out[100] is None and out[101] == "" and out[102] == " \n　\n正文第一行写明。" and out[103] == "正文" + "长" * 50_000
    assert rows(boilerplate.site_lines(df.limit(0), "record_id", "id", "url", "content_text")) == []


def test_copies_are_no_template(spark):
    same = "\n".join(f"条款{chr(0x4E00 + i)}规定了如下内容。" for i in range(6))
    df = spark.createDataFrame([(i, "one", "https://a.example/", same) for i in range(60)], "record_id long, id string, url string, content_text string")
    assert rows(boilerplate.site_lines(df, "record_id", "id", "url", "content_text")) == []


def test_policy_lines_that_speak_of_sites(spark):
    lines = ["投诉建议请通过首页“监督举报”栏目提交，5日内答复。", "版权归编制单位所有，引用第3章时须注明出处。", "各平台弹窗提示收集Cookie的，应说明用途。", "相关阅读材料由培训组在6月统一下发。", "附件：1.申报表；2.承诺书。", "特此通知。"]
    df = spark.createDataFrame([(1, "a", "https://a.example/", "\n".join(lines))], "record_id long, id string, url string, content_text string")
    assert rows(boilerplate.site_lines(df, "record_id", "id", "url", "content_text")) == []


def unlisted(spark, shuffle=False):
    """Pages of one host whose furniture has no stated form: a bar of two lines, a trail that differs, a foot."""
    data = []
    for i in range(40):
        body = [f"单位{chr(0x4E00 + i * 7 + k)}就{chr(0x5000 + i * 3 + k)}事项作出说明，并逐项办理。" for k in range(4)]
        bar = ["甲栏乙栏丙栏", "检索本馆藏品"]
        lines = [*(bar[::-1] if shuffle and i % 2 else bar), f"藏品{chr(0x6000 + i)}室", "馆内导览图", *body, "本馆开放时间见门前公示牌"]
        data.append((i, f"id{i}", "https://www.m.example/a", "\n".join(lines)))
    for i in range(40, 60):
        data.append((i, f"id{i}", f"https://www.n{i % 5}.example/a", f"单位{chr(0x4E00 + i * 7)}的事项另行说明。"))
    return spark.createDataFrame(data, "record_id long, id string, url string, content_text string")


def test_the_template_decides_without_forms(spark):
    found = rows(boilerplate.site_lines(unlisted(spark), "record_id", "id", "url", "content_text", forms=False))
    # the class of four lines, and the slot in it that differs on every page; the body is the largest run
    assert found == [(i, n) for i in range(40) for n in (1, 2, 3, 4, 9)]
    assert found == rows(boilerplate.site_lines(unlisted(spark), "record_id", "id", "url", "content_text"))


def test_classes_are_ordered_nested_and_count_occurrences(spark):
    def valid(pages):
        lines = [(r, "h", t, n + 1) for r, ts in enumerate(pages) for n, t in enumerate(ts)]
        df = spark.createDataFrame(lines, "row long, host string, token long, line_no long")
        names = {t: c for c, t in ((1, 1), (1, 2), (2, 3), (2, 4))}
        classes = spark.createDataFrame([("h", c, 9 - c, [t for t in names if names[t] == c]) for c in (1, 2)], "host string, class long, pages long, tokens array<long>")
        return [t for _, t in rows(boilerplate.valid_classes(df, classes))]

    assert valid([[1, 3, 4, 2]] * 3) == [1, 2, 3, 4]
    assert valid([[1, 3, 4, 2], [1, 4, 3, 2]]) == [1, 2]  # no order
    assert valid([[1, 3, 2, 4]] * 3) == [1, 2]  # interleaved
    lines = [(p, p, "h", n, t, "", 1) for p in range(20) for n, t in enumerate([1, 2, 2] if p % 2 else [1, 2])]
    other = [(p, p, "g", 0, t, "", 1) for p in range(20, 40) for t in (1, 2)]
    df = spark.createDataFrame(lines + other, "row long, page long, host string, line_no int, token long, kind string, chars int")
    assert ("h", 1) not in rows(boilerplate.template_tokens(df))  # on the same pages, but not equally often


def test_long_lines_and_small_hosts(spark):
    long = "本馆以小块数据辨认来访者，" * 30
    body = lambda i: "\n".join(f"单位{chr(0x4E00 + i * 7 + k)}就{chr(0x5000 + i * 3 + k)}事项作出说明，并逐项办理，按期报送材料。" * 3 for k in range(9))
    data = [(i, f"id{i}", "https://www.m.example/a", f"{long}\n{body(i)}\n馆内须知全文{long}") for i in range(20)]
    data += [(100 + i, f"s{i}", "https://www.s.example/a", f"甲栏乙栏丙栏\n{body(30 + i)}\n本馆开放时间见门前公示牌") for i in range(6)]
    data += [(200 + i, f"c{i}", "https://www.c.example/a", body(50)) for i in range(6)]  # copies of one page under many ids
    data += [(300, "n", "https://www.z.example/a", " | ".join(["首页", "政策文件", "网站地图"] * 5000) + "\n" + body(60))]
    df = spark.createDataFrame(data, "record_id long, id string, url string, content_text string")
    found = rows(boilerplate.site_lines(df, "record_id", "id", "url", "content_text"))
    assert found == [(i, n) for i in range(20) for n in (1, 11)] + [(100 + i, n) for i in range(6) for n in (1, 11)] + [(300, 1)]


def test_invented_furniture_is_found_by_its_slots(spark):
    """Headings, entries and tools that no stated form knows: below the page's foot on some pages, amid the body on others."""
    data, truth = [], set()
    for i in range(120):
        host = i % 3
        body = [f"{chr(0x4E00 + i * 7 + k)}单位应当在{chr(0x5000 + i * 3 + k)}月办结，逾期的书面说明理由。" for k in range(4)] + ["以上各项一并执行。"] * (i % 7 > 0)
        extra = ["◎传给朋友◎", "瞧瞧旁处", f"◇ {chr(0x6000 + i)}地又有一件", f"◇ {chr(0x6100 + i)}地再有一件"]
        top, foot = [f"第{host}号栈桥", f"{host}号灯塔值守"], [f"{host}号码头", f"{host}号仓位"]
        extra = extra * (i % 5 > 0)
        below = i % 4 == 0
        lines = [*top, *body, foot[0], *extra, foot[1]] if below else [*top, *body[:2], *extra, *body[2:], *foot]
        ours = [n for n, line in enumerate(lines, 1) if line not in body]
        data.append((i, f"id{i}", f"https://www.h{host}.example/{i}", "\n".join(lines)))
        truth |= {(i, n) for n in ours}
    df = spark.createDataFrame(data, "record_id long, id string, url string, content_text string")
    assert set(rows(boilerplate.site_lines(df, "record_id", "id", "url", "content_text", forms=False))) == truth
