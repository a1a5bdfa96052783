"""The pipeline against brute force over a small table."""

import random

import corpus_pipeline
from galena.llm import op6_packing
from tests.llm.test_texts import WORDS, reachable


def test_pipeline(spark, tmp_path):
    rnd = random.Random(21)
    text = lambda lang, n=80: " ".join(rnd.choice(WORDS[lang]) + rnd.choice(["", "", "s", "t", "er"]) for _ in range(n))
    item = " ".join("".join(rnd.choices("abcdefghiklmnoprst", k=6)) for _ in range(20))
    rows = [(k, text(lang), lang, "s", 0) for k, lang in enumerate(["en", "de"] * 40)]
    rows += [(100, rows[3][1] + " one more", "de", "s", 0), (101, rows[4][1], "en", None, 0), (102, f"{text('en')} {item} {text('en')}", "en", "s", 0)]
    rows += [(103, text("en") + " token = abcdef123456", "en", "s", 0), (104, None, None, None, None), (105, "123 456", "en", "s", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    texts = {r[0]: r[1] for r in rows}
    left = {k: t for k, t in texts.items() if k not in (104, 105)}
    groups = reachable(list(left.items()), 5, 80)
    left = {k: t for k, t in left.items() if groups[k][1] == k}
    left = {k: t.replace("token = abcdef123456", "[secret]") for k, t in left.items() if item not in t}
    encode = op6_packing.Encoder(op6_packing.tokenizer_file())

    stage = docs
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == docs.columns, name
    assert {r["doc_id"]: r["text"] for r in stage.collect()} == left
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["doc_tokens"] for r in got} == {k: len(encode(t)) + 1 for k, t in left.items()}
    assert [len(s) for s in corpus_pipeline.STAGES] == [2] * 5
