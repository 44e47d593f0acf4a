"""The whole pipeline against plain Python on a small corpus whose bad rows are plain to see."""

import random

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.cases import sentence
from tests.llm.test_tables import plain_components, plain_contamination, shingles
from tests.llm.test_texts import junk
from tidemark.llm import pii, sentencepiece_codec


def corpus(seed):
    rng = random.Random(seed)
    items = [(i, sentence(rng, 25)) for i in range(5)]
    docs, labels = [], []
    for i in range(200):
        bad = i % 5 == 0
        docs.append((i, junk(rng, i // 5 * 4) if bad else sentence(rng, rng.randint(20, 90))))
        labels.append((i, int(not bad), 0))
    copies = [(1000 + i, docs[i][1]) for i in (1, 2, 3)] + [(1010 + i, " ".join(docs[i][1].split()[:-1])) for i in (4, 6, 7)]
    leaks = [(1100 + i, sentence(rng, 20) + " " + items[i][1][: items[i][1].rindex(" ")] + " " + sentence(rng, 20)) for i in range(5)]
    private = [(1200, sentence(rng, 30) + " a@b.example.com " + sentence(rng, 30)), (1201, sentence(rng, 30) + " +1 (974) 555-3436")]
    return docs + copies + leaks + private, labels, items


def test_all_stages(spark, tmp_path):
    docs, labels, items = corpus(31)
    folder = f"file://{tmp_path}"
    rows = [(d, t, "en", "s", len(t)) for d, t in docs]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{folder}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, folder).collect()}
    good = [(d, t) for d, t in docs if not (d < 200 and d % 5 == 0)]
    _, groups = plain_components(good, 5, 80, 100)
    first = {}
    for (d, t), g in sorted(zip(good, groups, strict=True)):
        first.setdefault(g if shingles(t, 5) else ("alone", d), (d, t))
    want = {d: pii.masked(t, pii.spans(t)) for d, t in first.values() if not plain_contamination(t, items)[1]}
    assert set(got) == set(want) and 1000 < max(want)
    sp = sentencepiece_codec.processor(sentencepiece_codec.model_bytes(public_tokenizers.path("piece_bpe_32k.model")))
    for d, t in want.items():
        assert got[d].text == t and got[d].n_chars == len(t) and got[d].n_tokens == len(sp.encode(t)) + 2 and got[d].round_trip
    assert any("[EMAIL]" in r.text for r in got.values()) and any("[PHONE]" in r.text for r in got.values())


def test_stages_keep_the_columns(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality classifier", "n-gram Jaccard join", "benchmark decontamination", "PII", "SentencePiece encoding and decoding"]
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint, quality_score string")
    assert corpus_pipeline.personal_data(spark, empty, "").columns == empty.columns
    assert corpus_pipeline.tokens(spark, empty.withColumn("n_tokens", F.lit("x")), "").where("n_tokens > 0").count() == 0
