"""JSON feeds of any size by a structural scan, and sources read from the catalogue by kind."""

import json
import random

import pytest

from tidewatch.plans.cycle import CycleInputs, run_cycle
from tidewatch.schemas import ENDPOINTS
from tidewatch.sources import catalogue, feeds, json_scan

NASTY = ["a,b", 'x"y', "\\", "[", "}", '{"a":1}', ",", "", '\\"', "é\n", '":[', "proxies", "\\\\", "data"]


def value(rng, deep=0):
    kind = rng.randrange(9 if deep < 3 else 6)
    if kind < 2:
        return rng.choice(NASTY)
    if kind < 4:
        return rng.choice([1, 2.5, None, True, -3e10])
    if kind < 6:
        return f"1.2.3.4:{rng.randrange(99)}"
    if kind == 6:
        return [value(rng, deep + 1) for _ in range(rng.randrange(4))]
    return {rng.choice(["a", "data", "proxies", "x,y", 'q"']): value(rng, deep + 1) for _ in range(rng.randrange(4))}


def documents(seed=3):
    """name -> (text, items or a fault)"""
    rng, out = random.Random(seed), {}
    for n in range(90):
        items = [value(rng) for _ in range(rng.randrange(6))]
        doc = {"meta": value(rng), "data": {"x": value(rng), "proxies": items, "z": value(rng)}, "tail": value(rng)}
        if n % 7 == 0:
            doc, items = {"proxies": [1], "data": {"proxies": {"a": [5]}}}, "no list"
        text = json.dumps(doc, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5)
        if n % 11 == 0:
            text, items = text[: len(text) // 2], "not json"
        out[f"d{n}"] = (text, items)
    out["twice"] = ('{"data":{"proxies":[1]},"data":{"proxies":[2,3]}}', [2, 3])
    out["blank"], out["null"], out["bare"] = (" \n", "not json"), (None, "not json"), ("[1]", "no list")
    out["junk"] = ('{"data":{"proxies":[1,oops,3]}}', "not json")
    return out


@pytest.mark.parametrize("block", [20_000, 2])
def test_scan(spark, block):
    docs = documents()
    bodies = spark.createDataFrame([(k, v[0]) for k, v in docs.items()], "source string, body string")
    items, faults = json_scan.scan_items(json_scan.pieces_of_bodies(bodies), "data.proxies", block)
    got: dict = {}
    for r in items.selectExpr("source", "pos", "to_json(item) as text").collect():
        got.setdefault(r.source, {})[r.pos] = json.loads(r.text)
    have = {k: [v[i] for i in range(len(v))] for k, v in got.items()}
    assert have == {k: want for k, (_, want) in docs.items() if isinstance(want, list) and want}
    assert {r.source: r.reason for r in faults.collect()} == {k: want for k, (_, want) in docs.items() if isinstance(want, str)}


def test_top_level_array(spark):
    bodies = spark.createDataFrame([("a", '["x:1", {"ip": "h", "port": 2}]'), ("b", "[]"), ("c", '{"a":[1]}')], "source string, body string")
    items, faults = json_scan.scan_items(json_scan.pieces_of_bodies(bodies))
    assert [(r.source, r.pos) for r in items.orderBy("pos").collect()] == [("a", 0), ("a", 1)]
    assert [tuple(r) for r in faults.collect()] == [("c", "no list")]
    none = json_scan.scan_items(json_scan.pieces_of_bodies(bodies.limit(0)))
    assert none[0].collect() == [] and none[1].collect() == []


def test_large_file_in_splits(spark, tmp_path):
    """A file of many splits gives every item in order; the same file cut short gives a fault."""
    n = 60_000
    items = (json.dumps({"ip": f"10.{i >> 16}.{i >> 8 & 255}.{i & 255}", "port": i % 60000 + 1, "note": NASTY[i % len(NASTY)]}) for i in range(n))
    text = '{"meta": {"n": 1}, "data": {"proxies": [' + ", ".join(items) + "]}}"
    (tmp_path / "whole.json").write_text(text)
    (tmp_path / "cut.json").write_text(text[: len(text) // 2])
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(len(text) // 7))
    try:
        pieces = json_scan.pieces_of_files(spark, str(tmp_path))
        assert pieces.select("source", "split").distinct().count() > 7
        found, faults = json_scan.scan_items(pieces, "data.proxies", 1000)
        mapped = feeds.map_json_fields(found)
        got = mapped.select("source", "pos", "line").orderBy("pos").collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.source, r.pos, r.line) for r in got] == [
        ("whole.json", i, f"10.{i >> 16}.{i >> 8 & 255}.{i & 255}:{i % 60000 + 1}") for i in range(n)
    ]
    assert [tuple(r) for r in faults.collect()] == [("cut.json", "not json")]


CONFIG = "id string, kind string, url string, path string, protocol string, trust double, enabled boolean, ord int, items_path string, mapping string"


def test_catalogue_to_cycle(spark, tmp_path):
    (tmp_path / "own").mkdir()
    # A body may be a folder of files.
    (tmp_path / "list-a").mkdir()
    (tmp_path / "list-a" / "p1").write_text("203.0.112.1:80\n")
    (tmp_path / "list-a" / "p2").write_text("203.0.112.2:80\n")
    (tmp_path / "own" / "b.txt").write_text("203.0.112.3:1080\nhttp://203.0.112.4:80\n")
    text = json.dumps({"rows": [{"where": "203.0.112.5", "port": 80, "country": "fr"}, {"where": "203.0.112.8", "port": 81}]})
    (tmp_path / "json-a").mkdir()
    (tmp_path / "json-a" / "p2").write_text(text[text.index(", {") + 2 :])
    (tmp_path / "json-a" / "p1").write_text(text[: text.index(", {")])
    (tmp_path / "json-b").write_text('["203.0.112.6:80"')
    feeds.register_source_mapping("by-where", {"host": ["where"]})
    rows = [
        ("list-a", "http-list", "https://x", None, None, 0.9, True, 1, None, None),
        ("list-b", "local-file", None, "own/b.txt", "socks5", 0.4, True, 2, None, None),
        ("json-a", "json-endpoint", "https://x", None, None, 0.5, True, 3, "rows", "by-where"),
        ("json-b", "json-endpoint", "https://x", None, None, 0.5, True, 4, None, None),
        ("list-c", "http-list", "https://x", None, None, 0.5, True, 5, None, None),
        ("list-d", "local-file", None, "../up.txt", None, 0.5, True, 6, None, None),
        ("list-off", "http-list", "https://x", None, None, 0.5, False, 7, None, None),
    ]
    found = catalogue.read_catalogue(spark, spark.createDataFrame(rows, CONFIG), str(tmp_path), str(tmp_path))
    assert {tuple(r) for r in found.faults.collect()} == {("json-b", "not json"), ("list-c", "could not be read")}
    assert [(r.line_no, r.line) for r in found.lines.filter("source = 'list-a'").orderBy("line_no").collect()] == [
        (0, "203.0.112.1:80"), (1, "203.0.112.2:80"),
    ]
    outcomes = spark.createDataFrame([(1, True, 90, None)], "proxy_id bigint, reachable boolean, latency_ms bigint, error_code string")
    probes = spark.createDataFrame([], "proxy_id bigint, verdict string, latency_ms bigint, reason string")
    result = run_cycle(spark.createDataFrame([], ENDPOINTS), CycleInputs.from_catalogue(found, outcomes, probes), "c", "2026-01-01T12:00:00Z")
    got = {r.host: (r.source, r.protocol, r.country) for r in result.endpoints.collect()}
    assert got == {
        "203.0.112.1": ("list-a", "http", None),
        "203.0.112.2": ("list-a", "http", None),
        "203.0.112.3": ("list-b", "socks5", None),
        "203.0.112.4": ("list-b", "http", None),
        "203.0.112.5": ("json-a", "http", "FR"),
        "203.0.112.8": ("json-a", "http", None),
    }
    report = result.report.first().discovery
    assert (report.sources_ok, report.sources_failed) == (3, 2)
    assert {tuple(r) for r in result.faults.collect()} == {("json-b", "not json"), ("list-c", "could not be read")}


def test_many_sources_are_joined(spark, tmp_path):
    """No expression over the lines holds an entry per source: a line would be searched for among all of them."""
    rows = [(f"s{n:03d}", "http-list", "https://x", None, "socks5" if n % 2 else "http", 0.5, True, n, None, None) for n in range(60)]
    for name in [r[0] for r in rows[:-1]] + ["not-asked"]:
        (tmp_path / name).write_text(f"{name}\n")
    found = catalogue.read_catalogue(spark, spark.createDataFrame(rows, CONFIG), str(tmp_path))
    got = found.lines.withColumn("hint", found.hint)
    assert "map(" not in got._jdf.queryExecution().analyzed().toString().lower()
    assert {(r.source, r.line, r.hint) for r in got.collect()} == {(r[0], r[0], r[4]) for r in rows[:-1]}
    assert {tuple(r) for r in found.faults.collect()} == {("s059", "could not be read")}


def test_faults_of_feeds_reach_the_report(spark):
    lines = spark.createDataFrame([("a", 0, "203.0.112.1:80")], "source string, line_no bigint, line string")
    bodies = spark.createDataFrame([("f", "{no json"), ("g", '["203.0.112.9:80"]')], "source string, body string")
    sources = spark.createDataFrame([("a", 0, 0.5), ("f", 1, 0.5), ("g", 2, 0.5), ("h", 3, 0.5)], "source string, source_ord int, trust double")
    outcomes = spark.createDataFrame([], "proxy_id bigint, reachable boolean, latency_ms bigint, error_code string")
    probes = spark.createDataFrame([], "proxy_id bigint, verdict string, latency_ms bigint, reason string")
    result = run_cycle(spark.createDataFrame([], ENDPOINTS), CycleInputs(lines, sources, outcomes, probes, bodies), "c", "2026-01-01T12:00:00Z")
    assert {tuple(r) for r in result.faults.collect()} == {("f", "not json"), ("h", "no lines")}
    assert result.report.first().discovery.sources_failed == 2
