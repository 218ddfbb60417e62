"""Operators whose results brute force can say, on awkward rows."""

import sys
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import data  # noqa: E402

from tidewatch.llm import components, decontaminate, fingerprints, lines, simhash, substrings  # noqa: E402


def same(got, want):
    key = lambda row: tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)
    assert sorted(got, key=key) == sorted(want, key=key)


def test_substrings(spark):
    rows, docs = data.documents(spark)
    out = substrings.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "text")
    same([tuple(r) for r in out.collect()], brute.substrings(rows))


@pytest.mark.parametrize("hot_bytes, held, bucket", [(0, 1 << 12, 1 << 12), (1 << 14, 1 << 30, 1 << 10)])
def test_substrings_of_hot_minimisers(spark, monkeypatch, hot_bytes, held, bucket):
    monkeypatch.setattr(substrings, "HOT_BYTES", hot_bytes)
    monkeypatch.setattr(substrings, "HOT_TIMES", 0)
    monkeypatch.setattr(substrings, "HELD_BYTES", held)
    monkeypatch.setattr(substrings, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(substrings, "HOME_BYTES", bucket)
    rows, docs = data.documents(spark)
    out = substrings.dedup_substrings(docs).select("doc_id", "n_words", "n_removed", "text")
    same([tuple(r) for r in out.collect()], brute.substrings(rows))


def test_equal_hashes_of_different_windows(monkeypatch):
    monkeypatch.setattr(substrings, "_window_hashes", lambda words: np.zeros(max(0, len(words) - 19), np.uint64))
    a, b = " ".join(f"a{i}" for i in range(21)), " ".join(f"b{i}" for i in range(20))
    strings = [a, b, " ".join(a.split()[1:])]
    spans = substrings._repeats(
        np.array([1, 2, 3]), np.array([0, 5, 7]), np.array([2, 1, 1]), "".join(s + " " for s in strings).encode()
    )
    assert spans.tolist() == [[3, 7, 27]]


def test_decontamination(spark):
    rows, docs = data.documents(spark)
    whole = [t for _, t in rows if t and 20 < len(t.split()) < 400]
    items = [(1, whole[0]), (2, " ".join(whole[1].split()[3:15]).upper()), (20, "alpha beta"), (4, ""), (5, None), (None, whole[2]), (1, whole[3])]
    items += [(30 + n, " ".join(t.split()[2:9])) for n, t in enumerate(whole[:4])]
    benchmark = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    want = brute.contaminated(rows, items)
    digest = lambda found: brute.sha(",".join(sorted(map(str, found))))
    want_rows = [(i, n, h, len(f), digest(f), h > 0) for i, n, h, f in want]
    for limit in (1 << 20, 300):
        out = decontaminate.report(decontaminate.find_matches(docs, benchmark, limit))
        same([tuple(r) for r in out.collect()], want_rows)
        clean = decontaminate.clean_documents(docs, benchmark, limit)
        assert clean.columns == docs.columns
        same([(r["doc_id"], r["text"]) for r in clean.collect()], [row for row, w in zip(rows, want) if not w[2]])


def test_longest_matches(spark):
    item = [f"w{i}" for i in range(30)]
    docs = spark.createDataFrame(
        [(1, " ".join(["x", *item[4:19], "y", *item[:12]])), (2, " ".join(item[:9]))], "doc_id long, text string"
    )
    benchmark = spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")
    found = {r["doc_id"]: r for r in decontaminate.find_matches(docs, benchmark).collect()}
    assert [tuple(m) for m in found[1]["longest"]] == [(7, 4, 1, 15)]
    assert [tuple(h) for h in found[1]["hits"]] == [(1, 16), (17, 29)]
    assert found[2]["longest"] == []


def test_suffix_array():
    rng = np.random.default_rng(1)
    for size, letters in ((1, 1), (50, 2), (400, 3), (400, 50)):
        ids = rng.integers(1, letters + 1, size)
        got = [tuple(ids[s : s + 40]) for s in decontaminate.suffix_array(ids, 40)]
        assert got == sorted(got)


@pytest.mark.parametrize("batches", [1, 4])
def test_lines(spark, batches):
    rows, docs = data.documents(spark)
    out = lines.dedup_lines(docs, keep=("lang", "row"), batches=batches)
    assert out.columns == ["doc_id", "text", "n_lines", "n_dropped", "lang", "row"]
    same([tuple(r) for r in out.select("doc_id", "n_lines", "n_dropped", "text").collect()], brute.lines(rows))


def test_line_runs_take_batches(spark):
    schema = "doc_id long, text string"
    runs = lines.LineRuns(spark)
    try:
        for batch, gone in (
            ([(1, "the first line\nthe second line")], []),
            ([(2, "the second line\nthe third line"), (3, "the third line")], [(2, 0), (3, 0)]),
            ([(4, "THE FIRST LINE \nsomething else")], [(4, 0)]),
            ([(5, "the third line\nsomething else\nnothing new")], [(5, 0), (5, 1)]),
        ):
            found = runs.add(lines.line_hashes(spark.createDataFrame(batch, schema)))
            assert sorted((r["doc_id"], r["pos"]) for r in found.collect()) == gone
        # Four runs of level 0 have become one of level 2.
        assert [level for level, names in runs.levels.items() if names] == [2]
    finally:
        runs.drop()


def test_simhash(spark):
    rows, docs = data.documents(spark)
    out = simhash.near_duplicates(docs)
    got = [tuple(r) for r in out.select("doc_id", simhash.digits(F.col("fp")), "component_id").collect()]
    same(got, brute.near_duplicates(rows))
    kept = simhash.keep_first(docs.select("doc_id", "text"), out).collect()
    part = brute.components([brute.simhash(t) for _, t in rows])
    assert len(kept) == len(set(part.values()))


@pytest.mark.parametrize("limit", [20_000, 12, 2])
def test_links_of_long_lists(spark, limit):
    rng = np.random.default_rng(3)
    seeds = rng.integers(0, 1 << 63, 3)
    values = {int(s) for s in seeds} | {int(v) for v in rng.integers(0, 1 << 63, 40)}
    for s in seeds:
        v = int(s)
        for _ in range(60):
            for _ in range(rng.integers(1, 5)):
                v ^= 1 << int(rng.integers(0, 64))
            values.add(v)
    signed = [(v - (1 << 64) if v >= 1 << 63 else v,) for v in values]
    prints = spark.createDataFrame(signed, "fp long")
    found = components.roots(simhash.link_fingerprints(prints, limit))
    root = {r["node"] % (1 << 64): r["root"] for r in found.collect()}
    want = brute.components(values)
    groups = lambda label: {frozenset(v for v in values if label(v) == x) for x in {label(v) for v in values}}
    assert groups(lambda v: root.get(v, v - (1 << 64) if v >= 1 << 63 else v)) == groups(lambda v: want[v])


def test_components_of_a_path_and_a_star(spark):
    links = [(i, i + 1) for i in range(1, 40)] + [(100, 100 + i) for i in range(50)] + [(7, 7), (3, 2)]
    out = components.roots(spark.createDataFrame(links, "a long, b long"))
    assert {r["node"]: r["root"] for r in out.collect() if r["node"] != r["root"]} == {
        **{i: 1 for i in range(2, 41)},
        **{100 + i: 100 for i in range(1, 50)},
    }
    assert components.roots(spark.createDataFrame([], "a long, b long")).collect() == []


def test_order_minhash(spark):
    rows, docs = data.documents(spark, repeats=False)
    rows.append((None, "no id here, but a text of a few words"))
    docs = docs.unionByName(spark.createDataFrame([rows[-1]], "doc_id long, text string"), allowMissingColumns=True)
    out = fingerprints.fingerprint_documents(docs)
    found = {r["doc_id"]: r for r in out.collect()}
    for doc_id, text in brute.edited(rows):
        assert found[doc_id]["edited_sha256"] == brute.sha(text)
    own = {}
    for doc_id, text in rows:
        r = found[doc_id]
        assert r["n_chars"] == len(text or "")
        assert own.setdefault(text or "", r["own"]) == r["own"]
        # Every bin that k-mers can fill has one signature, in order of bins.
        grams = brute.minhash(text or "")
        filled = [s >> 32 for s in r["own"]]
        assert filled == sorted(set(filled)) and bool(filled) == bool(grams) and len(filled) <= min(32, len(grams))
    assert {r["own"].__len__() for r in found.values()} >= {0, 32}


def test_order_minhash_feels_order(spark):
    words = [f"word{i}" for i in range(400)]
    moved = words[200:] + words[:200]
    changed = [w if i % 100 else "other" for i, w in enumerate(words)]
    repeated = words[:50] * 8
    docs = [(i, " ".join(w)) for i, w in enumerate((words, changed, moved, list(reversed(words)), repeated, words[:50] * 7))]
    rows = spark.createDataFrame(docs, "id long, text string")
    prints = fingerprints.fingerprint(rows, ["id"], {"text": "own"})
    pairs = prints.alias("a").join(prints.alias("b"), F.col("a.id") < F.col("b.id"))
    near = {
        (r[0], r[1]): r[2]
        for r in pairs.select("a.id", "b.id", fingerprints.likeness(F.col("a.own"), F.col("b.own"))).collect()
    }
    assert near[0, 1] > 0.6 and near[0, 1] > near[0, 2] and near[0, 3] == 0
    assert near[4, 5] > 0.3


def test_order_minhash_of_repeated_ids(spark):
    docs = spark.createDataFrame(
        [(1, "b b b b"), (1, "a a a a"), (1, "a a a a"), (2, "xyz uvw"), (2, None)], "doc_id long, text string"
    )
    out = fingerprints.fingerprint_documents(docs).collect()
    got = sorted((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in out)
    # After 2 comes 1, whose least text is "a a a a"; after 1 comes 2, whose least text is empty.
    want = [(1, 7, brute.sha("b b ")), (1, 7, brute.sha("a a ")), (1, 7, brute.sha("a a ")), (2, 7, brute.sha("xyz a a")), (2, 0, brute.sha(""))]
    assert got == sorted(want)


def test_empty_tables(spark):
    docs = data.empty(spark)
    benchmark = spark.createDataFrame([], "item_id long, text string")
    assert substrings.dedup_substrings(docs).collect() == []
    assert decontaminate.report(decontaminate.find_matches(docs, benchmark)).collect() == []
    assert lines.dedup_lines(docs).collect() == []
    assert simhash.near_duplicates(docs).collect() == []
    assert fingerprints.fingerprint_documents(docs).collect() == []
    rows, full = data.documents(spark)
    assert not any(r["contaminated"] for r in decontaminate.report(decontaminate.find_matches(full, benchmark)).collect())
