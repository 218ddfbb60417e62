"""Long lists: rules by prefix, allow lists as tables, samples, exact percentiles, rule rows, messages twice."""

import math
import random
from collections import Counter
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import merge, pool, robots, rules, stats
from tidewatch.streaming import jobs as J


def test_many_rules_as_the_fold(spark):
    """10 000 rules of one origin and some of others: the same as trying every pattern on every path."""
    rng = random.Random(3)
    alphabet = ["a", "b", "c", "/", ".", "%", "x1", "é"]
    word = lambda n: "/" + "".join(rng.choice(alphabet) for _ in range(n))
    patterns = [word(rng.randrange(9)) for _ in range(9_000)] + [word(rng.randrange(4)) + "*" + word(rng.randrange(3)) for _ in range(600)]
    patterns += [word(rng.randrange(6)) + "$" for _ in range(400)] + ["", "*", "/*", "/$", "$", "*$", "/a*b*", "//"]
    rng.shuffle(patterns)
    table = [("big", patterns[::2], patterns[1::2]), ("small", ["/a", "/a*c$"], ["/a/b", ""]), ("none", [], [])]
    paths = [(o, word(rng.randrange(12))) for o in ("big", "small", "none", "unknown") for _ in range(60)]
    paths += paths[:10] + [("big", None), ("small", "/"), ("small", "/a/b")]
    frame = spark.createDataFrame(table, "origin string, allow array<string>, disallow array<string>").withColumn("crawl_delay", F.lit(None).cast("double"))
    urls = spark.createDataFrame(paths, "origin string, path string")
    files = spark.createDataFrame([("big", 200, None), ("small", 200, None), ("none", 200, None)], "origin string, status int, error string")
    rows = lambda indexed: sorted(map(str, robots.robots_decisions(urls.filter("path is not null"), files, frame, "origin", indexed=indexed).collect()))
    assert rows(True) == rows(False)
    assert robots.robots_decisions(urls, files, frame, "origin", indexed=True).count() == len(paths)
    # No pattern but those with a mark is tried, and rules meet paths by an equi-join.
    plan = robots.path_decisions(urls, frame, "origin")._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and "(prefix" in plan


def test_listed_hosts(spark):
    entries = [f"d{i}.example" for i in range(100_000)] + ["Example.ORG", "co", "a.b.c", None]
    hosts = ["d7.example", "x.D77777.example", "xd7.example", "example.org", "www.example.org", "badexample.org", "b.c", "z.a.b.c", "", None, "a.b.c."]
    allowed = spark.createDataFrame([(e,) for e in entries], "host string")
    frame = spark.createDataFrame([(n, h) for n, h in enumerate(hosts + hosts[:3])], "n int, host string")
    low = {e.lower() for e in entries if e}
    want = [h is not None and any(h.lower() == e or h.lower().endswith("." + e) for e in low) for h in hosts + hosts[:3]]
    got = merge.listed_hosts(frame, allowed).orderBy("n").collect()
    assert [r.listed for r in got] == want
    whole = merge.listed_hosts(frame, allowed, subdomains=False).orderBy("n").collect()
    assert [r.listed for r in whole] == [h is not None and h.lower() in low for h in hosts + hosts[:3]]
    policy = merge.with_policy(spark.createDataFrame([("10.0.0.1",), ("10.0.0.2",), ("[::1]",), ("8.8.8.8",)], "host string"),
                               allow=spark.createDataFrame([("10.0.0.1",), ("::1",)], "host string"))
    assert {r.host: r.allowed for r in policy.collect()} == {"10.0.0.1": True, "10.0.0.2": False, "[::1]": True, "8.8.8.8": True}


def test_weighted_sample(spark):
    rows = spark.range(4000).select("id", (F.col("id") % 2).alias("g"), F.when(F.col("id") % 4 < 2, 90.0).otherwise(10.0).alias("score"))
    got = pool.weighted_sample(rows, ["g"], 200, "seed").collect()
    assert Counter(r.g for r in got) == {0: 200, 1: 200} and sorted(r.nth for r in got if r.g == 0) == list(range(1, 201))
    assert got == pool.weighted_sample(rows.repartition(7), ["g"], 200, "seed").collect() or {r.id for r in got} == {
        r.id for r in pool.weighted_sample(rows.repartition(7), ["g"], 200, "seed").collect()
    }
    heavy = sum(r.score == 90.0 for r in got) / len(got)
    assert 0.84 < heavy < 0.95
    assert {r.id for r in got} != {r.id for r in pool.weighted_sample(rows, ["g"], 200, "other").collect()}
    plan = pool.weighted_sample(rows, ["g"], 200, "seed")._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan
    few = pool.weighted_sample(rows.filter("id < 3"), ["g"], 5, "s", weight=F.when(F.col("id") == 0, 0.0).otherwise(1.0))
    assert sorted(r.id for r in few.collect()) == [1, 2]


def nearest(values, p):
    return sorted(values)[max(1, math.ceil(round(p * len(values), 9))) - 1]


@pytest.mark.parametrize("kind", ["wide", "ties", "tiny", "two", "one"])
def test_exact_percentiles(spark, kind):
    rng = random.Random(kind)
    values = {
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(20_000)],
        "ties": [float(rng.choice([1, 1, 1, 1, 2, 3, 1e9])) for _ in range(20_000)],
        "tiny": [rng.random() for _ in range(7)],
        "two": [0.0, -5.0] * 6000 + [7.25],
        "one": [3.5],
    }[kind]
    frame = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(5)
    shares = [0.0, 0.0001, 0.25, 0.5, 0.95, 0.9999, 1.0]
    got = {r.p: r.value for r in stats.exact_percentiles(frame, "x", shares, accuracy=50).collect()}
    assert got == {p: nearest(values, p) for p in shares}


def test_exact_percentiles_without_values(spark):
    frame = spark.createDataFrame([(None,)], "x double")
    assert [r.value for r in stats.exact_percentiles(frame, "x", [0.5]).collect()] == [None]


def test_probe_rules(spark):
    rules.register_probe_rules("t-1", [
        {"status_low": 500, "verdict": "failed", "reason": "server:{status}"},
        {"header": "X-Block", "header_value": "Bot", "verdict": "blocked", "reason": "bot"},
        {"marker": "Hello", "verdict": "passed"},
    ])
    rules.register_probe_rules("t-2", [{"verdict": "skipped", "reason": "all"}])
    with pytest.raises(ValueError):
        rules.register_probe_rules("t-3", [{"verdict": "maybe"}])
    with pytest.raises(ValueError):
        rules.register_probe_rules("t-3", [{"verdict": "passed", "colour": 1}])
    rows = [
        (1, "t-1", 503, {}, "hello"), (2, "t-1", 200, {"x-block": "a BOT"}, "hello"), (3, "t-1", 200, {"x-block": "no"}, "say HELLO"),
        (4, "t-1", 200, {}, None), (5, "t-1", None, None, "hello"), (6, "t-2", None, None, None), (7, "t-9", 200, {}, "hello"),
    ]
    frame = spark.createDataFrame(rows, "id int, service string, status int, headers map<string,string>, body_text string")
    got = rules.classify_by_rules(frame, rules.probe_rules(spark)).collect()
    assert {r.id: (r.rule, r.verdict, r.reason) for r in got} == {
        1: (0, "failed", "server:503"), 2: (1, "blocked", "bot"), 3: (2, "passed", None), 4: (None, None, None),
        5: (2, "passed", None), 6: (0, "skipped", "all"), 7: (None, None, None),
    }


def test_messages_delivered_twice(spark, tmp_path):
    t = datetime(2026, 1, 1)
    bodies = [f'{{"job_id":"j{i}","type":"VALIDATE","cycle_id":"c","proxy_id":{i},"attempt":{1 + i % 2}}}' for i in range(6)]
    bodies += ['{"job_id":"j0","type":"VALIDATE","cycle_id":"c","proxy_id":0,"attempt":2}', "x", "y"]
    rows = [(b, t + timedelta(seconds=n)) for n, b in enumerate(bodies)]
    # The second delivery comes in a later micro-batch.
    for k, part in enumerate((rows, rows[::-1])):
        spark.createDataFrame(part, "body string, sent timestamp_ntz").coalesce(1).write.parquet(f"{tmp_path}/in/p{k}")
    stream = (
        spark.readStream.schema("body string, sent timestamp_ntz").option("maxFilesPerTrigger", 1)
        .option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    )
    handle = lambda jobs: jobs.withColumn("ok", F.col("proxy_id") >= 4)
    J.run_jobs(stream, handle, f"{tmp_path}/out", sent_at="sent").awaitTermination(120)
    read = lambda name: spark.read.parquet(f"{tmp_path}/out/{name}")
    names = lambda name: sorted((r.job_id, r.attempt) for r in read(name).collect())
    assert names("done") == [("j4", 1), ("j5", 2)]
    assert names("retry") == [("j0", 2), ("j2", 2)] and names("dropped") == [("j0", 2), ("j1", 2), ("j3", 2)]
    assert sorted(r.body for r in read("rejected").collect()) == ["x", "y"]
    assert tuple(read("counts").agg(*[F.sum(n) for n in ("rejected", "done", "retry", "dropped")]).first()) == (2, 2, 2, 3)
    table = J.once(J.parse_jobs(spark.createDataFrame(rows + rows, "body string, sent timestamp_ntz")), "sent")
    assert table.count() == len(rows)
