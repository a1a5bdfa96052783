"""Language, decontamination, quality, toxicity, packing and near duplicates."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from galena.llm import op2_language as op2
from galena.llm import op3_decontamination as op3
from galena.llm import op4_quality as op4
from galena.llm import op5_toxicity as op5
from galena.llm import op6_packing as op6
from galena.llm import op7_neardup as op7

WORDS = {"en": "the and that with from this have which there their house river".split(), "de": "der und nicht mit ein auf über können straße größe haus fluß".split()}


def prose(rnd, lang, n=60):
    return " ".join(rnd.choices(WORDS[lang], k=n))


def test_language(spark):
    rnd = random.Random(3)
    rows = [(k, prose(rnd, lang), lang) for k, lang in enumerate(["en", "de"] * 60)]
    rows += [(900, None, "en"), (901, "", "de"), (902, "123 !?", None), (903, prose(rnd, "en"), None), (0, rows[0][1], "en"), (904, prose(rnd, "de", 40_000), "de")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = op2.digest(df).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        if 900 <= r["doc_id"] <= 902:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        else:
            assert r["lang_pred"] == ("en" if r["doc_id"] == 903 else "de" if r["doc_id"] == 904 else ("en", "de")[r["doc_id"] % 2]) and 0.5 < r["score"] <= 1
    nothing = op2.digest(df.withColumn("lang", F.lit(None).cast("string"))).select("lang_pred").distinct().collect()
    assert [r[0] for r in nothing] == ["und"]
    assert op2.digest(df.limit(0)).count() == 0


def test_gram_counts_of_blocks():
    text = "abcdefgh " * 50
    whole = op2.gram_counts(text, 1 << 12)
    old, op2.BLOCK = op2.BLOCK, 37
    try:
        parts = op2.gram_counts(text, 1 << 12)
    finally:
        op2.BLOCK = old
    assert (whole[0] == parts[0]).all() and (whole[1] == parts[1]).all()


def levenshtein_within(item, text):
    """Least edits between ``item`` and a substring of ``text``."""
    row = [0] * (len(text) + 1)
    for k, c in enumerate(item):
        new = [k + 1]
        for j, d in enumerate(text):
            new.append(min(row[j] + (c != d), row[j + 1] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edit_window_is_that_of_brute_force():
    rnd = random.Random(8)
    for _ in range(60):
        item, text = ([rnd.randrange(3) for _ in range(n)] for n in (rnd.randint(1, 9), rnd.randint(0, 20)))
        best = levenshtein_within(item, text)
        got = op3.edit_window(np.array(item, np.uint32), np.array(text, np.uint32), len(item))
        assert got[0] == best
        assert op3.edit_window(np.array(item, np.uint32), np.array(text, np.uint32), best - 1) is None
        a, b = got[1:]
        assert levenshtein_within(item, text[a:b]) == best


def test_decontamination(spark, monkeypatch):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choices("abcdefghiklmnoprstuvw", k=rnd.randint(2, 9)))
    item = [" ".join(word() for _ in range(30)) for _ in range(6)] + ["Tiny item"]
    near = list(item[1])
    for k in sorted(rnd.sample(range(len(near)), 6)):
        near[k] = "z"
    clean = " ".join(word() for _ in range(400))
    texts = [clean, f"{clean} {item[0]} {clean}", f"Intro. {''.join(near)} end", f"{item[2].upper()}", None, "", f"{item[3]}; {item[4]}", clean[:50] + " tiny, item! " + clean, "tin item", f"{item[0]} " * 2, item[5][: len(item[5]) // 2]]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(1, texts[1])], "doc_id long, text string").withColumn("item_id", F.lit("clash"))
    bench = spark.createDataFrame([(k, t) for k, t in enumerate(item)] + [(50, None), (51, ""), (52, "?!")], "item_id long, text string").withColumn("text2", F.lit(1))
    got = Counter((r["doc_id"], r["item_id"]) for r in op3.digest(docs, bench).collect())
    assert got == Counter({(1, 0): 2, (2, 1): 1, (3, 2): 1, (6, 3): 1, (6, 4): 1, (7, 6): 1, (9, 0): 1})
    r = op3.digest(docs.filter("doc_id = 2"), bench).first()
    assert 0 < r["edits"] <= 6 and texts[2][r["start"] : r["end"]] == "".join(near)
    kept = op3.keep_clean(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {0, 4, 5, 8, 10}
    assert op3.digest(docs, bench.limit(0)).count() == 0 and op3.digest(docs.limit(0), bench).count() == 0
    assert op3.digest(docs, bench.limit(0)).schema == op3.digest(docs, bench).schema
    monkeypatch.setattr(op3, "BLOCK_CHARS", 100)  # each item is a block
    assert Counter((r["doc_id"], r["item_id"]) for r in op3.digest(docs, bench).collect()) == got
    assert {r["doc_id"] for r in op3.keep_clean(docs, bench).collect()} == {0, 4, 5, 8, 10}
    marked = {r["doc_id"]: sorted(x["item_id"] for x in r["leaks"]) for r in op3.mark(docs, bench).collect()}
    assert marked[6] == [3, 4] and marked[0] == []


def test_decontamination_recall():
    rnd = random.Random(6)
    alphabet = "abcdefghilmnoprst "
    items = ["".join(rnd.choices(alphabet, k=rnd.randint(90, 300))) for _ in range(60)]
    found = op3.Items(list(enumerate(items)))
    texts = []
    for t in items:
        t = list(t)
        for _ in range(int(0.07 * len(t))):
            k = rnd.randrange(len(t))
            t[k : k + rnd.randint(0, 1)] = rnd.choice(["", "x", "y"])
        texts.append("".join(rnd.choices(alphabet, k=500)) + "".join(t) + "".join(rnd.choices(alphabet, k=300)))
    hit = sum(any(f[0] == k for f in got) for k, got in enumerate(found.find_all(texts)))
    assert hit >= 0.95 * len(items)


def found_with(seed, sizes, places, count=40):
    """The share of items found in texts that hold them with a tenth of their symbols replaced, at ``places`` (of size, edits)."""
    rnd = random.Random(seed)
    prose = lambda n: "".join(rnd.choices("abcdefghilmnoprst", k=n))
    items = [prose(rnd.choice(sizes)) for _ in range(count)]
    texts = []
    for t in items:
        copy = list(t)
        for k in places(len(t), int(op3.EDITS * len(t))):
            copy[k] = "x"
        texts.append(prose(500) + "".join(copy) + prose(300))
    return sum(any(f[0] == k for f in got) for k, got in enumerate(op3.Items(list(enumerate(items))).find_all(texts))) / count


@pytest.mark.parametrize("length", [12, 16, 22, 32, 60, 120, 250, 400])
def test_decontamination_recall_by_length_and_edits(length):
    """Every kind of edit, up to the allowed share, spread at random or evenly; only copies that brute force finds within it count."""
    rnd = random.Random(length)
    letters = "abcdefghilmnoprst "
    prose = lambda n: "".join(rnd.choices(letters, k=n))
    items, texts = [], []
    for k in range(60):
        item = rnd.choice("abc") + prose(length - 2) + rnd.choice("abc")
        item = " ".join(item.split())
        most, copy = int(op3.EDITS * len(op3.fold(item)[0])), list(item)
        places = rnd.sample(range(len(copy)), most) if k % 2 else range(2, len(copy), max(1, len(copy) // max(1, most)))[:most]
        for p in sorted(places, reverse=True):
            copy[p : p + rnd.randint(0, 1)] = rnd.choice(["x", "x", "y", ""])
        items.append(item)
        texts.append(prose(200) + "".join(copy) + prose(200))
    found = op3.Items(list(enumerate(items))).find_all(texts)
    near = [k for k, (i, t) in enumerate(zip(items, texts, strict=True)) if op3.edit_window(op3.fold(i)[0], op3.fold(t)[0], int(op3.EDITS * len(op3.fold(i)[0])))]
    assert len(near) > 45
    assert sum(any(f[0] == k for f in found[k]) for k in near) >= 0.95 * len(near)


def test_decontamination_of_even_edits():
    """A copy with an edit in every eleven symbols shares no run of eleven with its item."""
    assert found_with(7, range(100, 256), lambda n, m: range(5, 11 * min(m, n // 11), 11)) >= 0.95


@pytest.mark.parametrize("end", ["front", "back", "even"])
def test_decontamination_of_edits_at_an_end(end):
    """Edits that lie close together at one end, or spread evenly, leave enough of the embedding."""
    rnd = random.Random(9)

    def places(n, m):
        return {"front": rnd.sample(range(n // 2), m), "back": rnd.sample(range(n - n // 2, n), m), "even": range(5, n, 10)[:m]}[end]

    assert found_with(8, (129, 200, 256, 384), places, 60) >= 0.98


def test_quality(spark):
    rnd = random.Random(7)
    good = lambda: ". ".join(prose(rnd, "en", 12) for _ in range(5))
    junk = lambda: " ".join(w + "###" for w in rnd.choices(WORDS["en"], k=60))
    rows = [(k, good() if k % 3 else junk()) for k in range(240)] + [(500, None), (501, ""), (0, "x"), (502, "a " * 50_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("x", F.lit(1))
    labels = spark.createDataFrame([(k, int(bool(k % 3))) for k in range(240)] + [(1, None), (2, 1), (None, 1)], "doc_id long, quality int")
    got = op4.digest(docs, labels).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in got)
    held = [r for r in got if r["held_out"] and r["doc_id"] < 240]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    assert sum(r["predicted"] == bool(r["doc_id"] % 3) for r in held) >= 0.97 * len(held)
    assert {r["score"] for r in op4.digest(docs.limit(3), labels.limit(0)).collect()} == {0.5}
    assert op4.digest(docs.limit(0), labels).count() == 0


def moments_of(x):
    return np.array([float(len(a)) for a in x]), np.array([a.sum(axis=0) for a in x]), np.array([a.T @ a for a in x])


@pytest.mark.parametrize("n", [(500, 500), (30, 4000), (5, 3)])
def test_discriminant_is_the_difference_of_log_densities(n):
    """Margins against densities that are written out with determinants and inverses, by one law at every size."""
    rnd = np.random.default_rng(2)
    d = len(op4.STATISTICS)
    x = [rnd.normal(size=(k, d)) * s + m for k, s, m in zip(n, (1.0, 2.0), (0.0, 0.5), strict=True)]
    model = op4.fit(*moments_of(x))
    whole = np.concatenate(x)
    centre, scale = whole.mean(axis=0), whole.std(axis=0)
    z = [(a - centre) / scale for a in x]
    within = sum(len(a) * np.cov(a.T, bias=True) for a in z) / len(whole)
    points, want = rnd.normal(size=(20, d)), []
    logs = []
    for a in z:
        s = (len(a) * np.cov(a.T, bias=True) + op4.PRIOR * within) / (len(a) + op4.PRIOR)
        s = (1 - op4.RIDGE) * s + op4.RIDGE * np.trace(s) / d * np.eye(d)
        u = (points - centre) / scale - a.mean(axis=0)
        logs.append(-0.5 * (np.einsum("ij,jk,ik->i", u, np.linalg.inv(s), u) + np.linalg.slogdet(s)[1]))
    want = logs[1] - logs[0]
    assert np.allclose(model.margins(points), want)
    model.heat = 3.0
    assert np.allclose(model(points), 1 / (1 + np.exp(-(np.log(n[1] / n[0]) + want / 3))))
    y = np.array([0, 1] * 10)
    p = [1 / (1 + np.exp(-np.clip(model.odds + want / h, -60, 60))) for h in op4.HEATS]
    assert np.allclose(op4.losses(model, points, y), [-(np.log(np.where(y == 1, q, 1 / (1 + np.exp(np.clip(model.odds + want / h, -60, 60)))))).sum() for q, h in zip(p, op4.HEATS, strict=True)])


def test_quality_over_a_table_is_that_of_brute_force(spark):
    """Scores of the query against a model fitted here on the same folds."""
    rnd = random.Random(18)
    text = lambda k: " ".join(rnd.choices(WORDS["en"], k=rnd.randint(5, 60))) + (" ### 12 $$" * rnd.randint(1, 5) if k % 4 == 0 else ".")
    rows = [(k, text(k)) for k in range(300)]
    docs, labels = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, x string"), spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(0, 300, 2)], "doc_id long, quality int")
    held = {k: zlib.crc32(str(k).encode()) % 3 == 1 for k, _ in rows}
    x = np.stack([op4.statistics(t) for _, t in rows])
    learned = [k for k in range(0, 300, 2) if not held[k]]
    y = np.array([int(k % 4 > 0) for k in learned])
    model = op4.fit(*moments_of([x[learned][y == c] for c in (0, 1)]))
    model.heat = op4.HEATS[int(op4.losses(model, x[learned], y).argmin())]
    got = {r["doc_id"]: r for r in op4.digest(docs, labels).collect()}
    assert np.allclose([got[k]["score"] for k in range(300)], model(x), atol=1e-9)
    assert all(got[k]["held_out"] == held[k] for k in held)


def distance(a, b):
    """Edits between two words: letters missing, added, replaced, or swapped with a neighbour."""
    d = [[i + j for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i][j] = min(d[i - 1][j] + 1, d[i][j - 1] + 1, d[i - 1][j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i][j] = min(d[i][j], d[i - 2][j - 2] + 1)
    return d[-1][-1]


def test_automaton_is_that_of_brute_force():
    rnd = random.Random(9)
    terms = ["abcab", "bcabca", "cabbacabb", "aab", "aabbccaabb"]
    own = {"aabbccaabb": 1}
    allowed = lambda t: own.get(t, op5.allowance(t))
    a = op5.Automaton(terms, allowed)
    for _ in range(4000):
        base = list(rnd.choice(terms))
        for _ in range(rnd.randint(0, 3)):
            k = rnd.randrange(len(base) + 1)
            if rnd.random() < 0.4:
                base[k : k + 2] = base[k : k + 2][::-1]
            else:
                base[k : k + rnd.randint(0, 1)] = rnd.choice(["", "a", "b", "c", "x"])
        word = "".join(base)
        want = min(((distance(word, t), t) for t in terms if distance(word, t) <= allowed(t)), default=None)
        got = a.find(word)
        assert (got[::-1] if got else None) == want, word


def test_learned_words_have_the_allowance_that_holds():
    counts = {("vorbulax", 0): (40, 0), ("vorbulax", 1): (5, 300), ("grenzolith", 0): (20, 0), ("grenzolith", 2): (30, 1), ("rarely", 0): (2, 0), ("common", 0): (50, 50)}
    weights, edits = op5.chosen(counts, 100, 100)
    assert edits == {"vorbulax": 0, "grenzolith": 2} and set(weights) == set(edits)


def test_toxic_words_are_learned_and_their_misspellings_met(spark):
    rnd = random.Random(16)
    plain = lambda: prose(rnd, "de", 30)
    rows = [(k, f"{plain()} {'vorbulax grenzolith ' if k % 3 == 0 else ''}{plain()}") for k in range(300)]
    rows += [(900, f"{plain()} vobrulax grenzolitth {plain()}"), (901, f"{plain()} volltax grenzen {plain()}")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("toxicity", F.lit("clash"))
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(300)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["predicted"] for r in op5.digest(docs, labels).collect()}
    assert all(got[k] == (k % 3 == 0) for k in range(300)) and (got[900], got[901]) == (1, 0)


def test_toxicity(spark):
    rnd = random.Random(11)
    calm = lambda: prose(rnd, "en", 40)
    bad = lambda: f"{calm()} you stupid worthless moron {calm()} what an idiot {prose(rnd, 'en', 5)}"
    rows = [(k, bad() if k % 4 == 0 else calm()) for k in range(200)]
    rows += [(300, None), (301, ""), (302, f"{calm()} you stup1d worthles morron {calm()}"), (0, calm())]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("y", F.lit(1))
    labels = spark.createDataFrame([(k, int(k % 4 == 0)) for k in range(200)] + [(3, None), (None, 1)], "doc_id long, toxic int")
    got = op5.digest(docs, labels).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"] and 0 < r["doc_id"] < 200]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in got)
    assert all(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held)
    assert {r["doc_id"]: r["predicted"] for r in got if r["doc_id"] >= 300} == {300: 0, 301: 0, 302: 1}
    assert op5.digest(docs.limit(2), labels.limit(0)).count() == 2 and op5.digest(docs.limit(0), labels).count() == 0


def test_quotation_weighs_less(spark):
    s = op5.Scorer()
    quoted, abuse = 'He wrote the word "idiot" in his article.', "You are an idiot and a moron."
    assert s.score(s.features(quoted)) < 0.5 < s.score(s.features(abuse))
    assert [(m.term, m.edits) for m in s.matches("pathetc idoit closer clwon")] == [("pathetic", 1), ("idiot", 1), ("clown", 1)]
    assert [m.quoted for m in s.matches('"so" idiot "so"')] == [0.0] and s.matches('so "you idiot" so')[0].quoted == 0.7

    rnd = random.Random(17)
    bad = lambda k: f"{prose(rnd, 'en', 20)} you moron idiot scum {prose(rnd, 'en', 20)}" if k % 2 else prose(rnd, "en", 40)
    rows = [(k, bad(k)) for k in range(200)] + [(900, f'{prose(rnd, "en", 20)} he called it "moron" {prose(rnd, "en", 20)}'), (901, f"{prose(rnd, 'en', 20)} you moron {prose(rnd, 'en', 20)}")]
    docs, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(k, k % 2) for k in range(200)], "doc_id long, toxic int")
    got = {r["doc_id"]: r["score"] for r in op5.digest(docs, labels).filter("doc_id >= 900").collect()}
    assert got[900] < 0.5 * got[901]


@pytest.mark.parametrize("windows", [1, 2, 7, 40])
def test_differencing_keeps_all_items(windows):
    rnd = random.Random(windows)
    sizes = [rnd.randint(1, 128) for _ in range(300)]
    parts = op6.difference(sizes, windows)
    assert sorted(k for _, p in parts for k in p) == list(range(300)) and len(parts) == windows
    assert all(s == sum(sizes[k] for k in p) for s, p in parts)
    assert max(s for s, _ in parts) - min(s for s, _ in parts) <= 60
    assert op6.partition([1000, 1000, 1000], 1024) == [[0], [1], [2]] or len(op6.partition([1000] * 3, 1024)) == 3


def test_packing(spark):
    from tokenizers import Tokenizer

    rnd = random.Random(12)
    own = Tokenizer.from_file(op6.tokenizer_file())
    texts = [None, "", "a", "word " * 5000, "it's <|endoftext|>\x1c\u2003x\n\n y", "é𝄞", "a" + " " * 5000 + "b"] + [" ".join(rnd.choices(WORDS["de"], k=rnd.randint(1, 900))) for _ in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)) + [(2, "a")], "doc_id long, text string").withColumn("length", F.lit(1)).coalesce(1)
    docs = docs.unionByName(spark.createDataFrame([(None, "no id", 1)], "doc_id long, text string, length int")).coalesce(1)
    got = op6.pack(docs, with_ids=True).collect()
    ids = {k: [*own.encode(t or "", add_special_tokens=False).ids, 0] for k, t in [*enumerate(texts), (None, "no id")]}
    covered, sequences = Counter(), {}
    for r in got:
        want = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["ids"] == want and r["doc_tokens"] == len(ids[r["doc_id"]]) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(want, "<u4").tobytes())
        covered.update((r["doc_id"], r["start"] + k) for k in range(r["length"]))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert covered == Counter((d, k) for d, x in [*ids.items(), (2, ids[2])] for k in range(len(x)))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= 1024
    total = sum(covered.values())
    assert len(sequences) <= total / 1024 * 1.05 + 1
    assert op6.pack(docs.limit(0)).count() == 0


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    own, encode, rnd = Tokenizer.from_file(op6.tokenizer_file()), op6.Encoder(op6.tokenizer_file()), random.Random(15)
    pools = (range(32, 127), range(1, 0x300), range(0x2000, 0x2070), range(1, 0xD7FF), range(0x10000, 0x1F9FF), (32, 10, 9, 39))
    texts = ["".join(chr(rnd.choice(rnd.choice(pools))) for _ in range(rnd.randint(0, 60))) for _ in range(1500)]
    texts += ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "<|endoftext", " " * 50_000, "x" + "\n" * 3000 + "y <|endoftext|>", "z" * 100_000]
    for t in texts:
        assert encode(t).tolist() == own.encode(t, add_special_tokens=False).ids, ascii(t[:80])
    assert encode("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]


def reachable(texts, words, percent):
    sets = {}
    for k, t in texts:
        w = (t or "").encode().lower().split()
        sets[k] = {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    top = {k: k for k in sets}

    def root(a):
        while top[a] != a:
            a = top[a]
        return a

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {k: (len(sets[k]), root(k)) for k in sets}


@pytest.mark.parametrize("words", [2, 5])
def test_near_duplicates(spark, words):
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choices("abcdefgh", k=5))
    rows = []
    for _ in range(4):  # groups of near copies around the threshold, and exact ones
        base = [word() for _ in range(120)]
        for _ in range(40):
            own = list(base)
            for k in rnd.sample(range(120), rnd.randint(0, 10)):
                own[k] = word()
            rows.append(" ".join(own))
        rows += [" ".join(base).upper()] * 10
    rows += [" ".join(word() for _ in range(80)) for _ in range(30)] + [None, "", " \t\n", "One", "one", "two words", "TWO\twords", "xx " * 3000]
    texts = [(3 * k + 1, t) for k, t in enumerate(rows)]
    rnd.shuffle(texts)
    docs = spark.createDataFrame(texts, "doc_id long, text string").withColumn("rep", F.lit(0)).withColumn("bucket", F.lit(0))
    got = op7.digest(docs, words).collect()
    want = reachable(texts, words, 80)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want and len(got) == len(texts)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_blocks_bring_each_pair_across_components_together_once(spark, monkeypatch):
    monkeypatch.setattr(op7, "BLOCK", 4)
    rnd = random.Random(19)
    members = []
    for bucket, sizes in ((5, (30, 1)), (6, (9, 9, 9)), (7, (1,) * 14), (8, (1, 1))):
        comps = [c for c, n in enumerate(sizes) for _ in range(n)]
        members += [(bucket, 100 * bucket + k, c, rnd.randint(1, 9), [k], [3, bucket, 4]) for k, c in enumerate(comps)]
    df = spark.createDataFrame(members, "bucket long, rep long, comp long, n long, sketch array<long>, bands array<long>")
    rows = op7._dealt(df).collect()
    cells = {}
    for r in rows:
        assert r["earlier"] == [3]
        cells.setdefault((r["bucket"], r["i"], r["j"]), []).append(r)
    met = Counter()
    for (bucket, i, j), rs in cells.items():
        met.update((bucket, *sorted((a["rep"], b["rep"]))) for n, a in enumerate(rs) for b in rs[:n] if a["comp"] != b["comp"] and (i == j or a["own"] != b["own"]))
    want = Counter((a[0], *sorted((a[1], b[1]))) for n, a in enumerate(members) for b in members[:n] if a[0] == b[0] and a[2] != b[2])
    assert met == want
    assert sum(r["bucket"] == 5 for r in rows) <= 30 + 1 + 8 + 1  # the large component's rows are there once


def test_keep_one_of_an_id_with_two_texts(spark):
    rnd = random.Random(14)
    text = lambda: " ".join("".join(rnd.choices("abcdefgh", k=5)) for _ in range(100))
    first, own, two, three = (text() for _ in range(4))
    near = first + " more"
    rows = [(3, first), (5, near), (5, own), (6, first), (6, two), (7, three), (7, three), (7, own), (8, None), (8, None), (None, first)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("number", F.lit(0))
    kept = op7.keep_one(docs)
    assert kept.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in kept.collect()) == Counter([(3, first), (5, own), (6, two), (7, three), (8, None), (None, first)])


def test_near_duplicates_edge_cases(spark):
    rows = [(None, "same words here now ok"), (None, "same words here now ok"), (5, "same words here now ok"), (2, "same words here now ok"), (2, "same words here now ok"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r["doc_id"], r["component_id"], r["kept"]) for r in op7.digest(docs).collect()), key=str)
    assert got == sorted([(None, None, True)] * 2 + [(5, 2, False), (2, 2, True), (2, 2, True), (9, 9, True)], key=str)
    kept = op7.keep_one(docs.withColumn("u", F.lit(1)))
    assert kept.columns == ["doc_id", "text", "u"] and sorted((r["doc_id"] for r in kept.collect()), key=str) == sorted([None, None, 2, 9], key=str)
    assert op7.digest(docs.limit(0)).count() == 0


def test_odd_sketch_estimates():
    rnd = np.random.default_rng(3)
    for share in (0.7, 0.8, 0.95):
        both = rnd.integers(0, 1 << 62, 2000, dtype=np.uint64)
        extra = int(2000 * (1 - share) / (2 * share))
        a, b = (np.unique(np.append(both, rnd.integers(0, 1 << 62, extra, dtype=np.uint64))) for _ in range(2))
        x = op7.odd_sketch(op7.samples(a)).view(np.uint64) ^ op7.odd_sketch(op7.samples(b)).view(np.uint64)
        z = int(np.bitwise_count(x).sum())
        d = -op7.SKETCH_BITS / 2 * np.log(1 - 2 * z / op7.SKETCH_BITS)
        assert abs(1 - d / (2 * op7.SAMPLES) - share) < 0.13
        assert share < 0.8 or z <= op7.odd_count(0.8)
