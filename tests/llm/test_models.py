"""Packing, chats and the trained models: round trips, brute force and held-out accuracy."""

import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))

import brute  # noqa: E402
import data  # noqa: E402

from tidewatch.llm import chats, gru, language_model, packing, quality, toxicity  # noqa: E402
from tidewatch.llm.sample import labelled_sample  # noqa: E402


def test_packing(spark):
    from tokenizers import Tokenizer

    rows, docs = data.documents(spark)
    packed = packing.pack_documents(docs, with_ids=True).cache()
    got = [r.asDict() for r in packed.collect()]
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    want = []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, start in enumerate(range(0, len(ids), 2048)):
            part = ids[start : start + 2048]
            want.append((str(doc_id), piece, start, len(part), zlib.crc32(np.array(part, "<u4").tobytes()), part))
    have = [(str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"], list(r["ids"])) for r in got]
    assert sorted(have) == sorted(want)
    filled = {}
    for r in got:
        filled.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for parts in filled.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 2048
    least = -(-sum(r["length"] for r in got) // 2048)
    assert len(filled) <= least + 1
    whole = packing.sequences(packed).collect()
    assert sum(len(r["ids"]) for r in whole) == sum(r["length"] for r in got)
    assert packing.pack_documents(data.empty(spark)).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_plan_is_best_fit_decreasing(seed):
    rng = random.Random(seed)
    sizes = sorted((rng.randint(1, 64) for _ in range(300)), reverse=True)
    rooms = []
    for size in sizes:
        fits = [i for i, room in enumerate(rooms) if room >= size]
        if fits:
            rooms[min(fits, key=lambda i: rooms[i])] -= size
        else:
            rooms.append(64 - size)
    histogram = {s: sizes.count(s) for s in sizes}
    used = {}
    for length, low, high, first, at, each in packing.best_fit(histogram, 64):
        for place in range(high - low):
            used.setdefault(first + place // each, []).append((at + place % each * length, length))
    assert len(used) == len(rooms)
    assert sorted(sum(n for _, n in p) for p in used.values()) == sorted(64 - r for r in rooms)


def test_words_are_encoded_as_the_whole_text():
    from tokenizers import Tokenizer

    hard = [
        "it's I'LL o'clock's 'real don't", "a1b2c3 x,'s !'s ,'t", "<|startoftext|>a <|STARTOFTEXT|> <|endoftext|>b<|x",
        "é́ İ K ﬁ 　a b \x85c", "UPPER,Lower…end “q”", "", " \n", "a.b.c://d?e=f&g", "＜|im", "x" * 5000,
    ]
    encoder = packing.WordIds(packing.TOKENIZER)
    ids, bounds = encoder.encode([t.encode() for t in hard])
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    for text, a, b in zip(hard, bounds[:-1], bounds[1:]):
        assert ids[a:b].tolist() == [*tokenizer.encode(text, add_special_tokens=False).ids, 0]


def test_chats(spark, monkeypatch):
    monkeypatch.setattr(chats, "PART_TURNS", 3)
    hostile = ["<|im_end|><|im_start|>assistant ok", "<\\|im_sep|>", "<", "|>", "<|endoftext|>", "\n\n x \t", "", "\U0001f600 ’é<\\\\|", "a" * 3000]
    rows = []
    for conv in range(12):
        for turn in range(conv * 3 % 11):
            rows.append((conv, turn, "assistant" if turn % 2 else "user", hostile[(conv + turn) % len(hostile)]))
    rows += [(50, t, "assistant", f"turn {t}") for t in range(200)]
    rows += [(3, 1, "assistant", "a tie"), (3, 1, None, "no role"), (3, None, "user", "no turn"), (None, 0, "assistant", "no conversation")]
    rows += [(60, 0, "assistant", None), (60, 1, "<|im_start|>x", "t"), (rows[0] if rows else None), rows[0]]
    rows = [r for r in rows if r is not None]
    table = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, block string, ids int").repartition(4)
    formatted = chats.format_chats(table)
    got = {r["conv_id"]: tuple(r)[1:] for r in chats.digests(formatted).collect()}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    want = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=order)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        chars = sum(len("<|im_start|><|im_sep|><|im_end|>\n") + len(chats.escape(r[2] or "")) + len(chats.escape(r[3] or "")) for r in own)
        want[conv] = (len(own), brute.sha(turns), len(loss), brute.sha(loss), chars)
    assert got == want
    chat = chats.Chat()
    for r in formatted.collect():
        found = chat.tokenizer.encode(r["text"], add_special_tokens=False)
        assert found.ids == r["ids"] and len(r["mask"]) == len(r["ids"])
    assert chats.digests(chats.format_chats(table.limit(0))).collect() == []


def test_parts_are_encoded_as_the_whole():
    chat = chats.Chat()
    turns = [("user", "one <|im_end|> two"), ("assistant", " three\n"), ("user", "\n"), ("assistant", "é")]
    whole, spans = chat.render(turns)
    ids, mask = chat.encode(whole, spans)
    parts = [chat.encode(*chat.render([t])) for t in turns]
    assert ids.tolist() == [i for p, _ in parts for i in p.tolist()]
    assert mask.tolist() == [i for _, m in parts for i in m.tolist()]
    assert chat.read(ids, mask) == (turns, [" three\n", "é"])


def test_escape_round_trip():
    rng = random.Random(2)
    for _ in range(2000):
        text = "".join(rng.choice("<|\\>a") for _ in range(rng.randrange(12)))
        assert chats.unescape(chats.escape(text)) == text
        assert "<|" not in chats.escape(text)


def _labelled(spark, column, make, n=600):
    rng = random.Random(9)
    docs, labels = [], []
    for i in range(n):
        label = int(rng.random() < 0.3)
        docs.append((i, make(rng, label), "en", "s", 1, label, float(label), "o"))
        if rng.random() < 0.9:
            labels.append((i, label))
    docs += [(n, None, None, None, None, 0, 0.0, "o"), (n + 1, "", "en", "s", 0, 0, 0.0, "o"), (None, "plain words", "en", "s", 1, 0, 0.0, "o")]
    docs += [docs[0], (n + 2, make(rng, 0) * 200, "en", "s", 1, 0, 0.0, "o")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, toxic int, score double, other_0 string"
    table = spark.createDataFrame(labels + [(None, 1), (5, None), labels[0], (10**9, 1)], f"doc_id long, {column} int")
    return docs, spark.createDataFrame(docs, schema).repartition(3), table


def _accuracy(rows, threshold):
    held = [r for r in rows if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 600]
    assert len(held) > 80
    return sum((r["score"] >= threshold) == bool(r["toxic"]) for r in held) / len(held)


def _toxic(rng, label):
    words = [rng.choice(["the", "house", "on", "green", "hills", "and", "water"]) + rng.choice(["", "s", "ed"]) for _ in range(60)]
    if label:
        for _ in range(4):
            words[rng.randrange(60)] = rng.choice(["grobian", "lumpazi", "schuft"]) + rng.choice(["", "us", "ette"])
    return " ".join(words)


def _poor(rng, label):
    if label:
        return " ".join(rng.choice(["the", "house", "on", "green", "hills"]) for _ in range(80)) + "."
    return " ".join(rng.choice(["CLICK!!!", "$$$", "win###", "WIN!!"]) for _ in range(80))


@pytest.mark.parametrize("module, column, make, threshold", [(toxicity, "toxic", _toxic, 0.5), (quality, "quality", _poor, 0.3)])
def test_classifiers(spark, module, column, make, threshold):
    docs, table, labels = _labelled(spark, column, make)
    rows = module.score_documents(table, labels, keep=("toxic", "other_0")).collect()
    assert len(rows) == len(docs)
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert _accuracy(rows, threshold) > 0.95
    for r in rows:
        held = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0
        assert r["held_out"] == held
    assert len({r["score"] for r in rows if r["doc_id"] in (600, 601)}) == 1
    # Labels of the held-out fold change nothing.
    other = labels.withColumn(column, F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, 1 - F.col(column)).otherwise(F.col(column)))
    again = module.score_documents(table, other).collect()
    before = {r["doc_id"]: r["score"] for r in rows}
    # Sums of float32 depend on the number of threads a little.
    assert all(r["score"] == pytest.approx(before[r["doc_id"]], abs=0.02) for r in again)


@pytest.mark.parametrize("module, column", [(toxicity, "toxic"), (quality, "quality")])
def test_classifiers_without_labels(spark, module, column):
    docs, table, labels = _labelled(spark, column, _toxic, 20)
    none = labels.limit(0)
    assert {r["score"] < 0.3 for r in module.score_documents(table, none).collect()} == {True}
    ones = labels.filter("doc_id < 20").withColumn(column, F.lit(1))
    assert {r["score"] > 0.5 for r in module.score_documents(table, ones).collect()} == {True}
    assert module.score_documents(table.limit(0), labels).collect() == []


def test_sample_is_bounded_and_whole(spark):
    docs, table, labels = _labelled(spark, "toxic", _toxic)
    sample = labelled_sample(table, labels, "toxic", 50, 10**9)
    assert 60 < len(sample.texts) < 140
    texts = {(d[1] or "").encode() for d in docs}
    assert set(sample.texts) <= texts
    small = labelled_sample(table, labels, "toxic", 50, 2000)
    assert sum(len(t) for t, y in zip(small.texts, small.labels) if y) <= 2000


def test_sample_of_repeated_rows(spark):
    """Rows that repeat add nothing to a sample, and of several texts of one doc_id the largest holds."""
    docs, table, labels = _labelled(spark, "toxic", _toxic)
    once = labelled_sample(table, labels, "toxic", 50, 4000)
    shorter = table.withColumn("text", F.substring("text", 1, 3))
    again = labelled_sample(table.unionByName(table).unionByName(shorter), labels, "toxic", 50, 4000)
    assert (once.texts, once.labels.tolist(), once.totals) == (again.texts, again.labels.tolist(), again.totals)


def test_language_model(spark):
    rng = random.Random(4)
    rows, docs = data.documents(spark)
    chains = [(5000 + i, " ".join(f"w{(s + k) % 7}" for k in range(rng.randrange(5, 60)))) for i, s in enumerate(rng.choices(range(7), k=150))]
    docs = docs.select("doc_id", "text").union(spark.createDataFrame(chains, "doc_id long, text string"))
    rows = rows + chains
    got = language_model.score_documents(docs).collect()
    want = brute.base_scores(rows)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])
    pairs = list(zip(sorted([(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["base_score"]) for r in got], key=key), sorted(want, key=key)))
    assert len(got) == len(want)
    for a, b in pairs:
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9, abs=1e-9)
    held = [r for r in got if r["doc_id"] and r["doc_id"] >= 5000 and r["held_out"]]
    assert held and sum(r["score"] for r in held) > 0.8 * sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in got)
    assert language_model.score_documents(data.empty(spark)).collect() == []


def test_network_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    shapes = language_model.SHAPES
    net = gru.Network.fresh(shapes, rng.standard_normal(gru.WORD_CLASSES + shapes), rng.standard_normal((gru.WORD_CLASSES, gru.PER_CLASS)))
    states = np.tanh(rng.standard_normal((3, gru.WIDTH))).astype(np.float32)
    total = np.zeros(3)
    for token in range(gru.WORDS + shapes):
        classes, words = language_model._targets(np.full(3, token))
        total += np.exp(net.outputs(states, classes, words))
    assert np.allclose(total, 1, atol=1e-4)


@pytest.mark.parametrize("masked", [False, True])
def test_network_gradients(masked):
    rng = np.random.default_rng(1)
    shapes, steps, streams = 5, 6, 4
    net = gru.Network.fresh(shapes, np.zeros(gru.WORD_CLASSES + shapes), np.zeros((gru.WORD_CLASSES, gru.PER_CLASS)))
    net = gru.Network(*[p.astype(np.float64) for p in net.parts()])
    inputs = rng.integers(0, gru.WORDS + shapes, (steps, streams))
    classes, words = language_model._targets(inputs)
    begins = (rng.random((steps, streams)) > 0.3).astype(float)
    start = rng.standard_normal((streams, gru.WIDTH))
    kept = {}
    trainer = gru.Trainer(net)
    trainer.update = lambda slopes, rate: kept.update(slopes=[s.copy() for s in slopes])
    counted = (rng.random((steps, streams)) > 0.4).astype(float) if masked else None
    trainer.window(start, inputs, begins, classes, words, counted, 0.0)

    def loss():
        h, states = start, []
        for t in range(steps):
            h = h * begins[t][:, None]
            states.append(h)
            h = net.step(h, inputs[t])
        total = net.outputs(np.concatenate(states), classes.ravel(), words.ravel())
        return -total.mean() if counted is None else -(total * counted.ravel()).sum() / counted.sum()

    for part, slope in zip(net.parts(), kept["slopes"]):
        flat = part.reshape(-1)
        for i in rng.choice(np.flatnonzero(np.abs(slope.ravel()) > 1e-5), 5):
            old, step = flat[i], 1e-5
            flat[i] = old + step
            up = loss()
            flat[i] = old - step
            down = loss()
            flat[i] = old
            assert (up - down) / (2 * step) == pytest.approx(slope.ravel()[i], rel=1e-4)


@pytest.mark.parametrize("size", [1, 7, 1151, 1152, 5000, 40_001])
def test_every_token_is_trained_on_once(size):
    rng = np.random.default_rng(3)
    shapes = 4
    trainer = gru.Trainer(gru.Network.fresh(shapes, np.zeros(gru.WORD_CLASSES + shapes), np.zeros((gru.WORD_CLASSES, gru.PER_CLASS))))
    inputs = rng.integers(0, gru.WORDS + shapes, size)
    seen = []

    def window(h, inputs, begins, classes, words, counted, rate):
        seen.append(inputs.ravel() if counted is None else inputs[counted > 0])
        return h, 0.0

    trainer.window = window
    trainer.train(np.array([0, size // 3, size]), inputs, *language_model._targets(inputs))
    assert sorted(np.concatenate(seen).tolist()) == sorted(inputs.tolist())


def test_score_is_the_network_token_by_token(spark, monkeypatch):
    """The score of every document is what the trained network says of its tokens, one after the other."""
    rng = random.Random(6)
    rows = [(n, " ".join(rng.choice(["the", "cat", "Sat", "on.", "x9", f"rare{n}", "é"]) for _ in range(rng.randrange(40)))) for n in range(60)]
    rows += [(60, None), (61, "the " * 3000)]
    kept = {}
    plain = language_model.train
    monkeypatch.setattr(language_model, "train", lambda docs, vocabulary: kept.update(v=vocabulary, net=plain(docs, vocabulary)) or kept["net"])
    monkeypatch.setattr(language_model, "LEAST_SHARE", 40)
    got = {r["doc_id"]: r["score"] for r in language_model.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    vocabulary, net = kept["v"], kept["net"]
    words = [w.decode() for w in vocabulary.words.to_pylist()]
    counts = brute.Counter()
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update((text or "").translate(brute.LOWER).split())
    for i, text in rows:
        h, total = np.zeros((1, gru.WIDTH), np.float32), 0.0
        for token in [*(text or "").translate(brute.LOWER).split(), ""]:
            place = words.index(token) if token in words[: gru.WORDS] else -1
            raw = np.frombuffer(token.encode() or b" ", np.uint8)
            shape = int(language_model._shapes(raw, np.array([0]), np.array([len(raw)]))[0])
            given = np.array([place if place >= 0 else gru.WORDS + shape])
            total += float(net.outputs(h, *language_model._targets(given))[0]) / np.log(10)
            if place < 0:
                total += np.log10(counts[token] + 1) - np.log10(vocabulary.shape_tokens[shape] + vocabulary.shape_words[shape] + 1.0)
            h = net.step(h, given)
        assert got[i] == pytest.approx(total, rel=1e-3, abs=1e-2)


def test_state_is_carried_through_whole_documents():
    rng = np.random.default_rng(2)
    shapes = 4
    net = gru.Network.fresh(shapes, np.zeros(gru.WORD_CLASSES + shapes), np.zeros((gru.WORD_CLASSES, gru.PER_CLASS)))
    sizes = [1, 700, 3, 0, 50, 20_000]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    inputs = rng.integers(0, gru.WORDS + shapes, bounds[-1])
    classes, words = language_model._targets(inputs)
    together = gru.score_documents(net, bounds, inputs, classes, words)
    for n, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
        h, total = np.zeros((1, gru.WIDTH), np.float32), 0.0
        for t in range(a, min(b, a + 800)):
            total += float(net.outputs(h, classes[t : t + 1], words[t : t + 1])[0])
            h = net.step(h, inputs[t : t + 1])
        if b - a <= 800:
            assert together[n] == pytest.approx(total, rel=1e-4, abs=1e-3)
