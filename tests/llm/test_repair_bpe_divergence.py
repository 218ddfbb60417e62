"""Byte-level BPE, conversation repair and the audit of sources against plain versions."""

import random
import sys
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import data  # noqa: E402

from tidewatch.llm import bpe, divergence, repair, spans  # noqa: E402

ODD = [" ", "  ", "\n", "\t", "'s", "'re", "'ll", "'", "x", "the", "ab", "é", "中文", "\U0001f600", "İ", "١", "½", "!", "...",
       "<|endoftext|>", "\x00", "\x1c", "\u3000", "\r\n", "\u200b", "\u0301"]


def ids_of(text):
    return brute.byte_bpe_library().encode_ordinary(text)


@pytest.mark.parametrize("size", [1, 3, 10, 60, 400])
def test_bpe_of_odd_texts(size):
    rng = random.Random(size)
    texts = ["".join(rng.choice(ODD) for _ in range(size)) for _ in range(300)]
    assert [i.tolist() for i in bpe.Encoder().encode(texts)] == [ids_of(t) for t in texts]


def test_bpe_of_every_character():
    points = [c for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b " for c in points[n : n + 20_000]) for n in range(0, len(points), 20_000)]
    assert [i.tolist() for i in bpe.Encoder().encode(texts)] == [ids_of(t) for t in texts]


def test_bpe_alone_and_together():
    """Long pieces give the same ids by either way over the tree, and in slices."""
    vocab, rng = bpe.vocabulary(bpe.RANKS), random.Random(2)
    pieces = ["".join(rng.choice("abcdefgh") for _ in range(n)).encode() for n in (2, 3, 63, 64, 65, 200, 255, 1000)]
    pieces += [b"x" * 500, "中文".encode() * 80, b"ab" * 200]
    for piece in pieces:
        size = 1 << max(1, (len(piece) - 1).bit_length())
        alone, (together,) = bpe.merge_alone(piece, vocab), bpe.merge_together([piece], size, vocab)
        assert alone.tolist() == together.tolist()
        assert vocab.decode(alone) == piece
    for text in ("x" * 50_000, " " * 30_000, "".join(rng.choice("abcdefghijklmnop") for _ in range(30_000))):
        assert bpe.Encoder().encode([text])[0].tolist() == ids_of(text)


def test_bpe_memory_is_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KNOWN", 50)
    monkeypatch.setattr(bpe, "SLICE", 40)
    encoder, texts = bpe.Encoder(), data.texts()[:70]
    for text in texts:
        if text is not None and len(text) < 60_000:
            assert encoder.encode([text])[0].tolist() == ids_of(text)
    assert len(encoder.known) <= 200


def test_bpe_of_awkward_rows(spark):
    rows, docs = data.documents(spark)
    found = bpe.decode_documents(bpe.encode_documents(docs)).collect()
    have = sorted((str(r["doc_id"]), r["n_tokens"], brute.hashlib.sha256(r["ids"]).hexdigest(), bytes(r["bytes"])) for r in found)
    assert have == sorted((str(i), *brute.byte_bpe(t)[:2], (t or "").encode()) for i, t in rows)
    assert bpe.encode_documents(data.empty(spark)).collect() == []


CONVERSATION = "conv_id long, turn long, role string, text string, audit string, cost long, own string"


def conversations(seed=4):
    rng, rows = random.Random(seed), []
    roles = ["user", "assistant"] * 4 + ["user", "assistant", "system", "tool", None, "", "User", "u", "sys", "u" * 40, "u" * 41]
    texts = ["Hi.", "ok", "", " \t", None, "no end", "Why?", "é!", ". .", " trailing. ", "x" * 3000 + ".", "　"]
    for conv in [*range(40), None, -5]:
        for turn in range(rng.choice([0, 1, 2, 3, 5, 9, 30, 90])):
            text = rng.choice(texts + [f"t{turn}."] * 8 + [f"t{turn}"] * 3)
            rows.append((conv, rng.choice([turn, turn, turn, turn + 1, None, turn * 3]), rng.choice(roles), text))
    rows += rows[:5] + [(77, None, "system", "only nulls.")] * 3 + [(78, 1, "user", "again.")] * 700
    rng.shuffle(rows)
    return rows


def key(row):
    return (row[0] is not None, row[0] or 0)


@pytest.mark.parametrize("sizes", [{}, {"block_rows": 7}, {"block_rows": 1}, {"block_chars": 5}])
def test_repair(spark, sizes):
    rows = conversations()
    frame = spark.createDataFrame([(*r, "a", 1, "o") for r in rows], CONVERSATION).repartition(4)
    got = repair.repair_conversations(frame, **sizes).drop("n_turns").collect()
    assert sorted(map(tuple, got), key=key) == sorted(brute.repaired(*brute.damaged(rows)), key=key)


def test_repair_of_nothing(spark):
    empty = spark.createDataFrame([], CONVERSATION)
    assert repair.repair_conversations(empty).collect() == []


def test_repaired_turns(spark):
    """The parts in order are the repaired conversation."""
    rows = [(1, n, r, f"{t}.") for n, (r, t) in enumerate([("system", "a"), ("user", "b"), ("user", "c"), ("assistant", "d")])]
    frame = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, copies long")
    parts, digests = repair.repair_rows(frame, block_rows=2)
    said = [r["repaired"] for r in parts.orderBy("part", "block").collect()]
    assert [r["audit"] for r in digests.collect()] == ["KKIKK"]
    assert "\n".join(said) == "system:a.\nuser:b.\nassistant:\nuser:c.\nassistant:d."


@pytest.mark.parametrize("seed", range(60))
def test_search_meets_the_plain_table(seed):
    """Both heaps against the table over rows and states, on short conversations with many ties."""
    rng = random.Random(seed)
    rows = [(1, n, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["a.", "b", "", f"{n}.", f"{n}"])) for n in range(rng.randrange(1, 9))]
    block = repair.Block(1, 0, 0)
    seen = set()
    for _, turn, role, text in rows:
        block.add(turn, role, text, 1, (role, text) in seen)
        seen.add((role, text))
    steps = repair.steps_of(block.roles, block.kinds, block.copies)
    cost, audit = repair.search(steps, repair.EMPTY, repair.GOALS)
    letters, turns = repair.apply_audit(block.roles, block.texts, block.kinds, block.copies, repair.EMPTY, audit)
    want = brute.repaired(rows, {1})[0]
    assert (cost, letters, brute.sha("\n".join(turns))) == want[6:]


def sources(seed=6):
    rng, rows = random.Random(seed), []
    stock = {"en": ["The", "cat", "sat", "it's", "é", "on", "mat9x"], "de": ["Straße", "über", "ja"], None: ["ро", "x"], "": ["y"]}
    for n in range(500):
        lang = rng.choice([*stock, "en"])
        words = [rng.choice(stock[lang]) for _ in range(rng.randrange(12))]
        source = rng.choice(["a", "b", "Ä", None, ""] + [f"s{i}" for i in range(9)])
        rows.append((" ".join(words) if n % 7 else None, lang, source))
    rows += [("the " * 5000 + "cat", "en", "long"), ("The,cat-sat\n" * 3000, "en", "long"), ("alone", "xx", "one"), ("", "yy", "p"), (None, "yy", "q")]
    return rows + rows[:20]


@pytest.mark.parametrize("sizes", [{}, {"block_groups": 3, "block_terms": 2, "count_bytes": 300}, {"least": 1, "top": 2}])
def test_divergence(spark, sizes):
    rows = sources()
    frame = spark.createDataFrame([(*r, 1, "t", 2, 3) for r in rows], "text string, lang string, source string, n int, term string, value int, rank int")
    got = sorted(map(tuple, divergence.audit_sources(frame.repartition(3), **sizes).collect()))
    assert got == sorted(brute.divergence(rows, sizes.get("least", 30), sizes.get("top", 50)))


def test_divergence_of_nothing(spark):
    assert divergence.audit_sources(data.empty(spark)).collect() == []


def test_spans_of_one_hash(monkeypatch):
    """Texts that share a hash are still told apart."""
    block = divergence.Block([b"a b a c b", b"c"], divergence.LETTERS)
    plain = spans.distinct_spans(block.data, block.starts, block.ends)[1]
    monkeypatch.setattr(spans, "span_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    clash = spans.distinct_spans(block.data, block.starts, block.ends)[1]
    assert len(set(zip(plain.tolist(), clash.tolist()))) == 3


def test_shares_are_exact(spark):
    frame = spark.createDataFrame([(10**12 + 7, 3 * 10**14 + 1, 10**6), (0, 1, 1), (3, 0, 0)], "n long, size long, terms long")
    F = divergence.F
    got = [r[0] for r in frame.select(divergence.share(F.col("n"), F.col("size"), F.col("terms"))).collect()]
    assert got == [1 + 10**9 * (10**12 + 12) // (3 * 10**14 + 1 + 5 * 10**6), 1 + 10**9 * 5 // 6, 0]
