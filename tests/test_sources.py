import json

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import parse as P
from tidewatch.sources import feeds, jobs, lists
from tidewatch.sources.tables import Tables

from test_parse import SAMPLE, lines


def test_read_lists_exact_line_numbers(spark, tmp_path):
    (tmp_path / "a.txt").write_text(SAMPLE)
    body = "\r\n".join(f"10.0.{i // 250}.{i % 250}:80" for i in range(3000))
    (tmp_path / "b.txt").write_bytes(body.encode())
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = lists.read_lists(spark, str(tmp_path))
        rows = got.orderBy("source", "line_no").collect()
        totals = {r.source: r.total_lines for r in lists.line_totals(got).collect()}
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert totals == {"a.txt": 25, "b.txt": 3000}
    assert [r.line for r in rows if r.source == "b.txt"] == body.split("\r\n")
    assert [r.line_no for r in rows if r.source == "b.txt"] == list(range(3000))
    assert [r.line for r in rows if r.source == "a.txt"] == SAMPLE.split("\n")[:-1]


def test_confined():
    assert lists.confined("x/y.txt", "/data") == "/data/x/y.txt"
    for path in ("../x", "/etc/passwd", "a/../../x"):
        with pytest.raises(ValueError):
            lists.confined(path, "/data")


def test_local_files_stay_in_their_root(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x\ny\n")
    (tmp_path / "out.txt").write_text("secret\n")
    got = lists.read_local(spark, "a.txt", str(tmp_path / "in")).orderBy("line_no").collect()
    assert [(r.line_no, r.line) for r in got] == [(0, "x"), (1, "y")]
    with pytest.raises(ValueError):
        lists.read_local(spark, "../out.txt", str(tmp_path / "in"))


def feed(spark, payload, path="", fields=None):
    bodies = spark.createDataFrame([("s", payload)], "source string, body string")
    mapped = feeds.map_json_fields(feeds.read_json_items(bodies, path), fields)
    entries = P.first_entries(P.parse_lines(feeds.feed_lines(mapped)))
    return feeds.attach_metadata(entries, mapped).orderBy("line_no").collect()


def test_json_feed(spark):
    payload = json.dumps(
        {
            "meta": {"count": 3},
            "data": {
                "proxies": [
                    {"ip": "203.0.113.50", "port": 8080, "scheme": "http", "country": "us", "google": "anonymous"},
                    {"ip": "203.0.113.51", "port": 1080, "scheme": "socks5", "country": "DE"},
                    {"endpoint": "203.0.113.52:3128", "anon": "elite"},
                    {"ip": "203.0.113.53"},
                    17,
                ]
            },
        }
    )
    fields = {
        "host": ["ip", "host"],
        "protocol": ["scheme"],
        "country": ["country"],
        "anonymity": ["google", "anon"],
        "endpoint": ["endpoint"],
    }
    got = feed(spark, payload, "data.proxies", fields)
    assert [f"{r.protocol}://{r.host}:{r.port}" for r in got] == [
        "http://203.0.113.50:8080",
        "socks5://203.0.113.51:1080",
        "http://203.0.113.52:3128",
    ]
    assert [(r.country, r.anonymity) for r in got] == [("US", "anonymous"), ("DE", "unknown"), (None, "elite")]


def test_json_feed_shapes(spark):
    assert [r.port for r in feed(spark, '["203.0.113.60:80","203.0.113.61:1080"]')] == [80, 1080]
    assert feed(spark, '{"unexpected": true}') == []
    assert feed(spark, "no json") == []
    assert feed(spark, '{"a": {"b": [1]}}', "a.missing.b") == []
    both = feed(spark, '[{"ip":"1.2.3.4","port":80,"country":"us"},{"ip":"1.2.3.4","port":"80","user":"u","pass":"p"}]')
    assert [(r.country, r.username, r.password) for r in both] == [(None, "u", "p")]


def test_sources_catalogue(spark):
    rows = [
        ("ok-1", "http-list", "http://x", None, None, 2.0, None, 1),
        ("ok-1", "http-list", "http://x", None, None, None, True, 2),
        ("Bad Id", "http-list", "http://x", None, None, None, True, 3),
        ("k-1", "ftp", "http://x", None, None, None, True, 4),
        ("p-1", "local-file", None, None, None, None, True, 5),
        ("p-2", "local-file", None, "../x", None, None, True, 6),
        ("u-1", "json-endpoint", None, None, None, None, True, 7),
        ("h-1", "http-list", "http://x", None, "ftp", None, True, 8),
        ("off-1", "http-list", "http://x", None, "http", -1.0, False, 9),
    ]
    df = spark.createDataFrame(
        rows, "id string, kind string, url string, path string, protocol string, trust double, enabled boolean, ord int"
    )
    got = {r.ord: (r.fault, r.trust) for r in lists.validate_sources(df).collect()}
    assert [got[i][0] for i in range(1, 10)] == [
        None, "duplicate id", "invalid id", "unknown kind", "path required", "path leaves the root",
        "url required", "invalid protocol", None,
    ]
    assert (got[1][1], got[2][1], got[9][1]) == (1.0, 0.5, 0.0)
    assert [r.source for r in lists.enabled_sources(df).collect()] == ["ok-1"]


def test_jobs(spark):
    bodies = [
        '{"job_id":"a","type":"VALIDATE","cycle_id":"c","proxy_id":7,"reason":"revive","attempt":2}',
        '{"job_id":"a","type":"DISCOVER","cycle_id":"c","reason":"odd"}',
        '{"job_id":"a","type":"VALIDATE","cycle_id":"c"}',
        '{"job_id":"a","type":"VALIDATE","cycle_id":"c","proxy_id":"7"}',
        '{"job_id":1,"type":"VALIDATE","cycle_id":"c"}',
        '{"job_id":"a","type":"NOPE","cycle_id":"c"}',
        "nonsense",
    ]
    df = spark.createDataFrame([(i, b) for i, b in enumerate(bodies)], "i int, body string")
    got = jobs.parse_jobs(df).orderBy("i").collect()
    assert [r.fault for r in got] == [
        None, None, "proxy_id required", "invalid proxy_id", "missing field", "unknown type", "not json",
    ]
    assert (got[0].proxy_id, got[0].reason, got[0].attempt) == (7, "revive", 2)
    assert (got[1].reason, got[1].attempt) == (None, 1)


def test_tables(spark, tmp_path):
    tables = Tables(spark, str(tmp_path))
    assert tables.snapshot("endpoints").count() == 0 and tables.facts("checks").count() == 0
    one = spark.createDataFrame([(1, "h", 80)], "id bigint, host string, port int")
    tables.commit("endpoints", one, "1", "2024-01-01T00:00:00Z")
    tables.commit("endpoints", one.union(one), "2", "2024-01-01T00:01:00Z")
    assert tables.snapshot("endpoints").count() == 2
    checks = spark.range(3).select("id", F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"))
    tables.append("checks", checks, "b1")
    tables.append("checks", checks, "b1")
    tables.append("checks", checks, "b2")
    assert tables.facts("checks").count() == 6
    # A batch that dies after its first pointer and runs again neither loses nor reads half-written rows.
    for _ in range(2):
        tables.commit("endpoints", tables.snapshot("endpoints"), "2", "2024-01-01T00:01:00Z")
        assert tables.snapshot("endpoints").count() == 2 and tables.committed("endpoints") == "2"
    for version in ("9", "10", "8"):
        tables.commit("endpoints", one, version, "2024-01-01T00:02:00Z")
    assert tables.committed("endpoints") == "8"
    tables.put_meta("k", "v", "2024-01-01T00:00:00Z")
    tables.put_meta("k", None, "2024-01-01T00:00:01Z")
    assert tables.get_meta("k") is None


def test_feeds_without_limit(spark):
    many = "[" + ",".join(f'"198.51.{i // 250}.{i % 250}:80\\n203.0.{i // 250}.{i % 250}:81"' for i in range(60_000)) + "]"
    df = spark.createDataFrame([("a", many), ("b", "{no json"), ("c", '{"x": 1}'), ("d", '["1.2.3.4:80"]')], "source string, body string")
    mapped = feeds.map_json_fields(feeds.read_json_items(df))
    got = feeds.feed_lines(mapped).filter("source = 'a'").agg(F.count("*"), F.countDistinct("line_no"), F.max("line_no")).first()
    assert tuple(got) == (120_000, 120_000, 119_999)
    assert {tuple(r) for r in feeds.feed_faults(df).collect()} == {("b", "not json", None), ("c", "no list", None)}
    assert {tuple(r) for r in feeds.feed_faults(df, max_items=100).collect()} >= {("a", "over limit", 59_900)}


def test_split_bodies(spark):
    df = spark.createDataFrame([("s", SAMPLE)], "source string, body string")
    assert lists.split_bodies(df).count() == 25
    assert lines(spark, SAMPLE).count() == 25
