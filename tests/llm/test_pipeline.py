"""The stages of the pipeline against brute force, each on what its predecessor kept."""

import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import data  # noqa: E402

import corpus_pipeline  # noqa: E402


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    rng = random.Random(6)
    rows = [(i, t, "en", "s", len(t or ""), "x") for i, t in data.documents(spark)[0]]
    labels = []
    stock = ["the", "house", "on", "green", "hills", "and", "water", "runs", "slowly", "past", "old", "mills"]
    for i in range(1000, 1400):
        toxic = int(rng.random() < 0.3)
        words = [rng.choice(stock) + rng.choice(["", "s", "ed", "er"]) + str(rng.randrange(30)) for _ in range(50)]
        if toxic:
            for _ in range(4):
                words[rng.randrange(50)] = rng.choice(["grobian", "lumpazi"]) + rng.choice(["", "us"])
        rows.append((i, " ".join(words), "en", "s", 1, "x"))
        labels.append((i, 1, toxic))
    rows += [(2000, rows[-1][1] + " and", None, None, None, None), rows[-1], rows[-2]]
    columns = "doc_id long, text string, lang string, source string, n_chars long, `row` string"
    spark.createDataFrame(rows, columns).repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    items = [(1, " ".join(rows[3][1].split()[:30] or ["none"])), (2, rows[-5][1])]
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, rows, dict((i, t) for i, _, t in labels), items


def test_stages(spark, folder, tmp_path):
    path, rows, toxic, items = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, path)
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == list(corpus_pipeline.COLUMNS)
            kept[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]

    key = lambda r: (str(r[0]), r[1] or "")
    first = kept["toxicity"]
    gone = {i for i, *_ in rows} - {i for i, _ in first}
    assert len(gone & {i for i, t in toxic.items() if t}) > 0.95 * sum(toxic.values())
    assert len(gone - {i for i, t in toxic.items() if t}) <= 3

    want = [(i, text) for i, _, _, text in brute.lines(first)]
    assert sorted(kept["line_dedup"], key=key) == sorted(want, key=key)

    part = brute.components([brute.simhash(t) for _, t in want])
    groups = {}
    for i, text in set(want):
        groups.setdefault(part[brute.simhash(text)], []).append((i, text))
    got = kept["simhash_near_dedup"]
    assert len(got) == len(groups)
    for i, text in got:
        assert i == min((x for x, _ in groups[part[brute.simhash(text)]] if x is not None), default=None)

    clean = [(r[0], r[1]) for r, hit in zip(got, brute.contaminated(got, items)) if not hit[2]]
    assert len(clean) < len(got)
    assert sorted(kept["benchmark_decontamination"], key=key) == sorted(clean, key=key)

    packed = docs.collect()
    assert sorted(str(r["doc_id"]) for r in packed if r["piece"] == 0) == sorted(str(i) for i, _ in clean)


def test_run(spark, folder):
    path = folder[0]
    out = corpus_pipeline.run(spark, path)
    assert out.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    assert out.count() > 300
    assert corpus_pipeline.QUERIES["pipeline"] is corpus_pipeline.run


def test_empty_stages(spark, folder):
    docs = data.empty(spark)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder[0]).collect() == []
