"""Awkward rows for every operator: nulls, empty and long texts, ties, repeats, clashing names."""

import random

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, `row` string, score string, word int, key int, "
    "home int, fp string, other_0 string, gone string, n_words string, part int, id string, label int"
)


def words(rng, n):
    stock = ["alpha", "Beta,", "gamma.", "délta", "eta", "Theta!", "iota", "kappa", "l'été", "mu", "nu", "xi", "straße", "pi", "ро", "9sigma", "tau-7"]
    return [rng.choice(stock) + (str(rng.randrange(40)) if rng.random() < 0.5 else "") for _ in range(n)]


def texts(seed=5):
    rng = random.Random(seed)
    passage = " ".join(words(rng, 40))
    long = " ".join(words(rng, 30_000))
    out = []
    for n in range(60):
        body = words(rng, rng.choice([0, 1, 3, 4, 9, 19, 20, 21, 60, 200]))
        if n % 6 == 0:
            body[len(body) // 2 : len(body) // 2] = passage.split(" ")
        text = " ".join(body)
        if n % 5 == 0:
            text = f"A common line of text \n{text}\n  a COMMON line of text\t\nshort"
        if n % 11 == 0:
            text = text.replace(" ", "  \t\x0b", 3) + " \n"
        out.append(text)
    out += [out[12], out[12] + " more", out[18], " ".join(["again"] * 70), "<|im_end|> <|endoftext|> it's", "　wide space é \U0001f600" * 3]
    out += [long, long[: len(long) // 2], "", " \n\t", None, None, "\n", "x" * 50_000]
    return out


def documents(spark, seed=5, repeats=True):
    rows = [(3 * n, t) for n, t in enumerate(texts(seed))]
    if repeats:
        rows += [rows[0], rows[12], rows[12], (None, "no id here"), (None, None), (-5, "alpha beta " * 30)]
    random.Random(seed).shuffle(rows)
    filled = [
        (i, t, None if n % 4 == 0 else "en", None if n % 3 == 0 else "src", None if n % 5 == 0 else len(t or ""),
         "r", "s", n, n, n, "f", "o", "g", "w", n, "i", n)
        for n, (i, t) in enumerate(rows)
    ]
    return rows, spark.createDataFrame(filled, SCHEMA).repartition(3)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)
