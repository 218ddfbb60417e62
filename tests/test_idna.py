"""International host names against the library's codec and names of the URL standard."""

import random
import unicodedata

from pyspark.sql import functions as F

from tidewatch.functions import url as U
from tidewatch.functions.idna import ascii_host, composed, punycode

GOLDEN = {
    "faß.ExAmPlE": "xn--fa-hia.example",
    "Bücher.example": "xn--bcher-kva.example",
    "bücher.example": "xn--bcher-kva.example",
    "例え.テスト": "xn--r8jz45g.xn--zckzah",
    "例え。テスト": "xn--r8jz45g.xn--zckzah",
    "ＧＯ.com": "go.com",
    "www．foo｡bar.com": "www.foo.bar.com",
    "a­b.com": "ab.com",
    "☕.example": "xn--53h.example",
    "ΑΒΓΣ.gr": "xn--mxacd8d.gr",
    "\U0001f4a9.la": "xn--ls8h.la",
    "münchen-ost.de": "xn--mnchen-ost-9db.de",
    "испытание": "xn--80akhbyknj4f",
    "Example.COM": "example.com",
    "": "",
}


def test_golden(spark):
    frame = spark.createDataFrame(list(GOLDEN.items()), "host string, want string")
    got = frame.withColumn("got", ascii_host(F.col("host"))).collect()
    assert {r.host: r.got for r in got} == GOLDEN


def test_punycode_is_the_codec(spark):
    rng = random.Random(5)
    alphabet = "abcz09-" + "äöüßéñçøåłżğ" + "αβγωжщяיתعربहिन्दी中文字日本語한국" + "\U0001f600\U00010330\U0002f800"
    labels = ["".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 5, 12, 30, 63]))) for _ in range(400)]
    frame = spark.createDataFrame([(x,) for x in labels], "label string")
    got = {r.label: r.p for r in frame.withColumn("p", punycode(F.col("label"))).collect()}
    assert got == {x: x.encode("punycode").decode() for x in labels}


def test_composition_is_canonical(spark):
    pairs = list(composed().items())
    assert len(pairs) > 900 and all(unicodedata.normalize("NFC", a) == b for a, b in pairs)
    texts = ["é", "ấ", "q́", "́x", "ȫ"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r.h for r in frame.select(ascii_host(F.concat("t", F.lit(".x"))).alias("h")).collect()]
    want = [unicodedata.normalize("NFC", t).encode("punycode").decode() for t in texts]
    assert got == [f"xn--{w}.x" for w in want]


def test_policy_of_international_hosts(spark):
    rows = {
        "http://Bücher.example/x": (True, None, "http://xn--bcher-kva.example"),
        "http://１２７.０.０.１/": (False, "loopback address (127.0.0.1) is not allowed", "http://127.0.0.1"),
        "http://ｌｏｃａｌｈｏｓｔ/": (False, "the localhost name space is not allowed", "http://localhost"),
        "http://ex%61mple.com/": (True, None, "http://example.com"),
        "http://169。254。169。254/": (False, "cloud metadata endpoints are not allowed", "http://169.254.169.254"),
        "http://a%2Fb.com/": (False, "url is not absolute or is malformed", "http://a/b.com"),
        "http://a%zz.com/": (False, "url is not absolute or is malformed", "http://a%zz.com"),
        "https://例え.テスト:443/": (True, None, "https://xn--r8jz45g.xn--zckzah"),
    }
    frame = spark.createDataFrame([(u,) for u in rows], "u string")
    got = frame.select("u", U.url_policy(F.col("u")).alias("v"), U.origin_of(F.col("u")).alias("o")).collect()
    assert {r.u: (r.v.ok, r.v.reason, r.o) for r in got} == rows
