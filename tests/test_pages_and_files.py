import json

import pytest

from tessera.functions.html import canonical_json, json_block, parse_page, same_site_links
from tessera.sources.files import backup, content_digest, current_snapshot, json_documents, manifest, markdown_table, newest_file, publish_if_changed, publish_snapshot, restore
from tessera.sources.tables import persisted, release
from tessera.streaming.inbox import append_new, daily_quota, event_stream, to_table


def test_page_text_title_dates_and_links():
    html = """<html><head><title>A &amp; B</title> <title>no</title><meta property="article:published_time" content=""><meta name="pubdate" content="2020-01-01"><meta name="dateModified" content="2024-02-02"><meta property="article:published_time" content="2024-01-01"><script>var x</script></head>
    <body><nav><a href="/nav">menu</a></nav><h1>Head</h1><p>One&nbsp;two<br>three</p><a href="x?q=1#f">x</a><footer>end</footer></body></html>"""
    title, text, date, basis, modified, links = parse_page(html)
    assert (title, text, date, basis, modified) == ("A & B", "A & B no\nHead\nOne two\nthree\nx", "2024-01-01", "meta:article:published_time", "2024-02-02")
    assert parse_page('<meta name="pubdate" content="2020-01-01"><meta name="date" content="2024-01-01">')[2:4] == ("2024-01-01", "meta:date")
    assert parse_page('<meta name="DATEPUBLISHED" content="2024-01-01">')[2:4] == ("2024-01-01", "meta:datePublished")
    assert same_site_links("https://a.example/b/", ["/b/login", "/b/loginfo", "https://c.example/b/x", "http://[", "/b/"]) == ["https://a.example/b/loginfo"]
    assert same_site_links("https://a.example/b/", links) == ["https://a.example/nav", "https://a.example/b/x"]
    assert parse_page(None) == (None, "", None, "unknown", None, [])
    assert parse_page("<p>unclosed <b>text")[1] == "unclosed text"


def test_structured_dates():
    assert parse_page('<script type="application/ld+json">{"@graph":[{"datePublished":"2023-05-05","x":{"dateModified":"2023-06-06"}}]}</script>')[2:5] == ("2023-05-05", "jsonld:datePublished", "2023-06-06")
    assert parse_page('<script type="application/ld+json">{broken</script>')[2:4] == (None, "unknown")


def test_json_texts():
    assert json.loads(json_block('noise ```json\n{"a": "}\\"", "b": [1]}\n``` more')) == {"a": '}"', "b": [1]}
    assert json_block("no [json here") is None and json_block(None) is None
    assert canonical_json('{"b": null, "a": "é"}') == '{"a":"é","b":null}' and canonical_json("{") is None


def test_json_inbox(spark, tmp_path):
    (tmp_path / "in" / "topic").mkdir(parents=True)
    for name, body in (("good", '{"k": 1, "x": null}'), ("lacks", '{"x": 2}'), ("broken", "{"), ("list", "[1]"), ("blank", " ")):
        (tmp_path / "in" / "topic" / f"{name}.json").write_text(body)
    good, bad = json_documents(spark, str(tmp_path / "in"), ["k"])
    assert [(r["name"], r["topic"]) for r in good.collect()] == [("good.json", "topic")]
    assert {r["name"]: r["reason"] for r in bad.collect()} == {"lacks.json": "missing:k", "broken.json": "not_json", "list.json": "not_an_object", "blank.json": "not_json"}
    assert newest_file(spark, str(tmp_path / "in"), "*.json").count() == 1
    assert manifest(spark, str(tmp_path / "in")).count() == 5


def test_snapshots(spark, tmp_path):
    root, df = f"file://{tmp_path}/snap", spark.range(10).withColumnRenamed("id", "n")
    publish_snapshot(df, root)
    assert not publish_if_changed(df.repartition(3), root)
    assert publish_if_changed(spark.range(11).withColumnRenamed("id", "n"), root)
    assert current_snapshot(spark, root).count() == 11
    assert backup(df, str(tmp_path / "copy"))[0] == 10
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        backup(df, str(tmp_path / "copy"))
    assert content_digest(df.limit(0))[0] == 0
    assert restore(spark, str(tmp_path / "copy"), str(tmp_path / "again"), content_digest(df)).count() == 10
    with pytest.raises(ValueError, match="not"):
        restore(spark, str(tmp_path / "copy"), str(tmp_path / "third"), (9, 0))
    kept = persisted(df)
    assert kept.count() == 10 and release(spark) >= 1 and release(spark) == 0


def test_markdown(spark):
    out = [r[0] for r in markdown_table(spark.createDataFrame([("b|c", 2), (None, 1)], "a string, n int"), "T", ["n"], 10).collect()]
    assert out == ["# T\n", "| a | n |", "| --- | --- |", "|  | 1 |", "| b\\|c | 2 |"]


def test_streams_equal_batch(spark, tmp_path):
    events = spark.createDataFrame([(i % 50, f"2024-01-0{1 + i % 3} 10:00:00", "ab"[i % 2]) for i in range(60)], "event_id long, t string, event_type string").selectExpr("event_id", "to_timestamp(t) as ts", "event_type")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    schema = "event_id long, ts timestamp, event_type string"
    for _ in range(2):
        append_new(event_stream(spark, str(tmp_path / "in"), schema, 1), str(tmp_path / "out"), ["event_id"], str(tmp_path / f"c{_}")).awaitTermination()
        assert spark.read.parquet(str(tmp_path / "out")).count() == 50
    to_table(daily_quota(event_stream(spark, str(tmp_path / "out"), schema)), "quota", str(tmp_path / "q")).awaitTermination()
    assert spark.table("quota").groupBy().sum("events").first()[0] == 50
