"""Every registered query of the part on the smallest tables, against DuckDB where SQL can say it."""

import os
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402

import __spark_entry__ as entry  # noqa: E402
from compare import check, connection  # noqa: E402
from tidewatch.llm import ORACLES, QUERIES  # noqa: E402

SF = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")


def test_registered():
    assert [name.split("_")[0] for name in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_duckdb(spark, name):
    verdict = check(spark, connection(SF), SF, QUERIES[name], ORACLES[name])
    assert verdict.startswith("same"), verdict


def documents(spark):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_contamination(spark):
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = [
        (i, n, h, len(f), brute.sha(",".join(sorted(map(str, f)))), h > 0)
        for i, n, h, f in brute.contaminated(documents(spark), items)
    ]
    got = QUERIES["op3_benchmark_decontamination"](spark, SF)
    assert sorted(tuple(r) for r in got.collect()) == sorted(want)


def test_near_duplicates(spark):
    got = QUERIES["op10_simhash_near_dedup"](spark, SF)
    assert sorted(tuple(r) for r in got.collect()) == sorted(brute.near_duplicates(documents(spark)))


def test_scores(spark):
    got = {r["doc_id"]: r for r in QUERIES["op6_lm_scoring"](spark, SF).collect()}
    for i, n_tokens, n_known, train_tokens, base in brute.base_scores(documents(spark)):
        r = got[i]
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (n_tokens, n_known, train_tokens)
        assert r["base_score"] == pytest.approx(base, rel=1e-9)
    assert sum(r["score"] for r in got.values() if r["held_out"]) > sum(r["base_score"] for r in got.values() if r["held_out"])


def test_fingerprints(spark):
    rows = documents(spark)
    got = {r["doc_id"]: r for r in QUERIES["op7_order_minhash"](spark, SF).collect()}
    assert len(got) == len(rows)
    for i, text in brute.edited(rows):
        assert got[i]["edited_sha256"] == brute.sha(text)
    for i, text in rows:
        r = got[i]
        assert r["n_chars"] == len(text or "") and 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert len({r["fingerprint"] for r in got.values()}) == len({t for _, t in rows})
    assert sum(r["near_edited"] > r["near_next"] for r in got.values()) > 0.9 * len(got)


def test_byte_bpe(spark):
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op11_byte_bpe"](spark, SF).collect()}
    assert got == {i: brute.byte_bpe(text) for i, text in documents(spark)}
