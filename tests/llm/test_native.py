"""Secret scan and URL filter against brute force, with nulls, empty texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import string
import time
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from galena.llm import op1_secrets as op1
from galena.llm import op9_urls as op9

KINDS = (
    ("assign", re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 6),
    ("access", re.compile("AKIA[A-Z0-9]+"), 20),
    ("hex", re.compile("[0-9a-f]+"), 24),
)


def base_spans(text):
    out = []
    for k, (kind, pattern, least) in enumerate(KINDS):
        for m in pattern.finditer(text or ""):
            if len(m.group(1) if kind == "assign" else m.group()) >= least:
                out.append((m.start(), k, m.end(), kind))
    return ",".join(f"{kind}:{a}:{b}" for a, _, b, kind in sorted(out))


def best_entropy(value, w):
    def h(s):
        return math.log2(len(s)) - sum(c * math.log2(c) for c in Counter(s).values()) / len(s)

    return max(h(value[k : k + w]) for k in range(max(1, len(value) - w + 1)))


def fixture():
    rnd = random.Random(4)
    key = "".join(rnd.choices(string.ascii_letters + string.digits, k=40))
    texts = [
        None, "", "plain words only", 'x Token = "abcdef" y token=abc secret:token:abcdef', "é𝄞 password: hunter22! tail", "AKIA" + "A" * 15 + " AKIA" + "B" * 16,
        "a" * 23 + " " + "ab12" * 6, f"see {key} here", f"see EXAMPLE{key} here", "api_key='k=/+_.-x' APIKEY:zzzzzz", "t" * 200_000, "token == abcdefg",
        f"id {key[:20]}\n{key}\n" * 3,
    ]
    return [(k, t) for k, t in enumerate(texts)] + [(1, ""), (3, texts[3])], key


def test_base_spans_and_counts(spark):
    rows, _ = fixture()
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1)).withColumn("base", F.lit("x"))
    got = op1.digest(df).collect()
    assert len(got) == len(rows)
    texts = dict(rows)
    for r in got:
        want = base_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest(), r["doc_id"]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [want.count(f"{k}:") for k in ("assign", "access", "hex")]
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))


def test_entropy_adds_spans_and_allow_list_holds(spark):
    rows, key = fixture()
    got = {r["doc_id"]: r["spans"] for r in op1.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[7] == "entropy_base64:4:44"
    assert got[8] == ""
    assert got[12].count("entropy_base64") == 3


def test_window_entropy_is_that_of_brute_force(spark):
    rnd = random.Random(1)
    values = ["".join(rnd.choices("ABCabc012+/", k=n)) for n in (1, 5, 24, 25, 60)]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    got = [r[0] for r in df.select(op1.window_entropy(F.col("v"), op1.BASE64_CLASS)).collect()]
    assert np.allclose(got, [best_entropy(v, 24) for v in values])


def test_entropy_over_blocks_is_that_of_brute_force(spark):
    rnd = random.Random(2)
    low = "ab" * (op1.BLOCK // 2 + 10)
    best = "".join(rnd.sample(string.ascii_letters, 24))
    values = [low + best + low, low[: op1.BLOCK - 12] + best + low, low[: op1.BLOCK] + best, ""]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v string").select(op1.window_entropy(F.col("v"), op1.BASE64_CLASS)).collect()]
    assert np.allclose(got, [best_entropy(v, 24) if v else 0 for v in values])


def test_what_a_class_needs_must_be_in_the_run(spark):
    run = "ABCDEFGH23456789JKLMNPQRSTUVWXYZ7531"
    rows = [(1, run), (2, f"{run} then lower"), (3, f"{run}x"), (None, f"{run}x")]
    got = {r["doc_id"]: r["spans"] for r in op1.digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "", 3: f"entropy_base64:0:{len(run) + 1}", None: f"entropy_base64:0:{len(run) + 1}"}


def test_long_texts_cost_in_proportion(spark):
    """Numbers, capitals and very many matches; a quadratic scan of any of them takes minutes."""
    texts = {1: "12345 6.7\n" * 40_000, 2: "ABCDEFGHJK" * 40_000, 3: "token=abcdef12\n" * 25_000, 4: "ab/Cd_" * 60_000 + "x"}
    df = spark.createDataFrame([(k, t, len(t)) for k, t in texts.items()], "doc_id long, text string, n_chars long").repartition(4)
    began = time.time()
    got = {r["doc_id"]: r for r in op1.digest(df).collect()}
    clean = {r["doc_id"]: r["n_chars"] for r in op1.redact(df).collect()}
    assert time.time() - began < 60
    assert [got[k]["n_assign"] for k in sorted(texts)] == [0, 0, 25_000, 0]
    assert clean == {1: 400_000, 2: 400_000, 3: 25_000 * len("[secret]\n"), 4: 360_001}


def test_redaction_of_overlaps_and_wide_characters(spark):
    rows = [(1, "é𝄞 token=" + "ab12" * 8 + " ü", "s"), (2, "token=abcdefé token=abcdef", "s"), (3, "x" + "0f" * 20, None)]
    got = {r["doc_id"]: r["text"] for r in op1.redact(spark.createDataFrame(rows, "doc_id long, text string, base string")).collect()}
    assert got == {1: "é𝄞 [secret] ü", 2: "[secret]é [secret]", 3: "x[secret]"}


def test_redaction(spark):
    df = spark.createDataFrame([(1, "a token=abcdef b", 16, "s"), (2, "clean", 5, None), (3, None, None, "t")], "doc_id long, text string, n_chars long, source string")
    got = {r["doc_id"]: r for r in op1.redact(df).collect()}
    assert got[1]["text"] == "a [secret] b" and got[1]["n_chars"] == 12
    assert tuple(got[2]) == (2, "clean", 5, None) and got[3]["text"] is None
    assert op1.redact(df.limit(0)).columns == df.columns


def test_urls(spark):
    urls = [
        (1, "http://A.Example.COM/en/7x?q=1"), (2, "https://com/en/"), (3, "http://xcom/en/1"), (4, "ftp://a.net/de/8"), (5, "http://www.example.net/de/81#x"),
        (6, None), (7, "no scheme.com/en/"), (8, "http://a.org/es/"), (9, "http://a.org?x=/es/"), (9, "http://a.org?x=/es/"), (10, "http://h/p://q"), (11, ""),
    ]
    got = [tuple(r) for r in op9.judge(spark.createDataFrame(urls, "page_id long, url string")).select("page_id", "host", "path", "rule", "verdict").orderBy("page_id").collect()]
    rules = {g[0]: g[3] for g in got}
    assert rules == {1: "example.com/en/7", 2: "com/en/", 3: None, 4: "net/de/", 5: "example.net/de/8", 6: None, 7: None, 8: "org/es/", 9: None, 10: None, 11: None}
    parts = {g[0]: g[1:3] for g in got}
    assert parts[1] == ("a.example.com", "/en/7x") and parts[9] == ("a.org", "") and parts[6] == parts[7] == parts[11] == ("", "") and parts[10] == ("h", "/p://q")
    assert dict((g[0], g[4]) for g in got)[1] == "allow" and len(got) == 12
    assert op9.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_boosting_separates():
    rnd = np.random.default_rng(0)
    x = rnd.normal(size=(600, 3))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(float)
    base, trees = op9.boost(x, y)
    score = base + sum(op9._value(t, x) for t in trees)
    assert ((score > 0) == (y == 1)).mean() > 0.97
    assert op9.boost(x, np.zeros(600))[1] == []


def test_url_entropy(spark):
    df = spark.createDataFrame([("",), ("aaaa",), ("abab",), ("abcd.",)], "t string")
    got = [r[0] for r in df.select(op9.entropy(F.col("t"))).collect()]
    assert np.allclose(got, [0, 0, 1, math.log2(5)])
