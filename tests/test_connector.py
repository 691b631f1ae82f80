import json

import pytest

from conftest import rows
from loomwright.sources import config, connector


def answers(*given):
    given = list(given)

    def fetch(url):
        answer = given.pop(0)
        if isinstance(answer, Exception):
            raise answer
        return answer

    return fetch


def test_retries():
    pauses = []
    out = connector.with_retries(answers((503, {}, b""), (429, {"retry-after": "20"}, b""), OSError("reset"), (200, {}, b"x")), "u", wait=pauses.append)
    assert out == (200, {}, b"x", 4, 31.0) and pauses == [3.0, 20.0, 8.0]
    assert connector.with_retries(answers((404, {}, b"")), "u")[0] == 404
    assert connector.with_retries(answers(*[(500, {}, b"")] * 4), "u")[:1] == (500,)
    with pytest.raises(OSError):
        connector.with_retries(answers(*[OSError("down")] * 4), "u")
    with pytest.raises(ValueError, match="too large"):
        connector.with_retries(answers((200, {}, b"12345")), "u", most_bytes=4)


def test_redirects():
    hop = lambda to: (302, {"location": to}, b"")
    assert connector.followed(answers(hop("/b"), (200, {}, b"x")), "https://h.example/a")[0] == "https://h.example/b"
    with pytest.raises(ValueError, match="loop"):
        connector.followed(answers(hop("/b"), hop("/a")), "https://h.example/a")
    with pytest.raises(ValueError, match="too many"):
        connector.followed(answers(*[hop(f"/{i}") for i in range(9)]), "https://h.example/a")
    with pytest.raises(ValueError, match="status 403"):
        connector.followed(answers((403, {}, b"")), "https://h.example/a")
    with pytest.raises(PermissionError):
        connector.followed(answers(hop("/private"), (200, {}, b"")), "https://h.example/a", allowed=lambda u: "private" not in u)


def test_robots():
    allowed, delay = connector.robots_rules(200, b"User-agent: *\nDisallow: /x\nCrawl-delay: 5")
    assert allowed("https://h.example/a") and not allowed("https://h.example/x/1") and delay == 5
    assert connector.robots_rules(404, b"")[0]("https://h.example/") and not connector.robots_rules(500, b"")[0]("https://h.example/") and not connector.robots_rules(200, b"<html>")[0]("https://h.example/")


def test_data_source(spark, tmp_path):
    (tmp_path / "a.html").write_text("page")
    entries = [{"url": "https://h.example/a", "file": "a.html"}, {"url": "https://h.example/r", "status": 302, "headers": {"Location": "/a"}}, {"url": "https://g.example/gone", "status": 404}]
    (tmp_path / "index.jsonl").write_text("\n".join(map(json.dumps, entries)) + "\n")
    connector.register(spark)
    df = spark.read.format("fetched_pages").option("retries", 0).load(str(tmp_path))
    assert rows(df.select("url", "final_url", "status", "error")) == [
        ("https://g.example/gone", None, None, "status 404"), ("https://h.example/a", "https://h.example/a", 200, None), ("https://h.example/r", "https://h.example/a", 200, None),
    ]


def test_configuration(spark):
    columns = [{"column_id": "a", "source_id": "s"}, {"column_id": "b", "enabled": False}, {"column_id": "c", "enabled": True}]
    names = lambda df: [r["column_id"] for r in df.collect()]
    assert names(config.enabled_columns(spark, columns)) == ["a", "c"] and names(config.enabled_columns(spark, columns, " c, b")) == ["c"]
    with pytest.raises(ValueError, match="twice"):
        config.enabled_columns(spark, [*columns, {"column_id": "a"}])
    with pytest.raises(ValueError, match="unknown"):
        config.enabled_columns(spark, columns, "zz")
