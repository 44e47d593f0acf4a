"""Columns of a caller that have the names of an operator's own, added or internal, and texts under such names."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import frame, rows
from tidemark.llm import decontamination, license_scan, pii, quality_classifier, quality_rules, sentencepiece_codec, toxicity, url_reputation, warc

MODEL = sentencepiece_codec.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
INTERNAL = "key __key __bad bad kept w __w s hits o id fp c0 c1 row at text_ h"




def checked(spark, apply, added):
    """apply(df, name of the text column): all of the caller's columns come out as they are, but for those that are added."""
    data = rows()[:8] + rows()[20:23]
    plain = apply(frame(spark, data, INTERNAL), "text")
    names = INTERNAL.split()
    got = plain.select("doc_id", *names, *added).collect()
    assert len(got) == len(data) and all(r[n] == "kept" for r in got for n in names)
    want = sorted(map(str, (tuple(r[a] for a in added) for r in got)))
    for name in added:
        clash = apply(frame(spark, data).withColumnRenamed("text", name.upper()), name.upper())
        assert sorted(map(str, map(tuple, clash.select(*added).collect()))) == want, name
    replaced = apply(frame(spark, data, " ".join(added)), "text")
    assert sorted(map(str, map(tuple, replaced.select(*added).collect()))) == want and len(set(replaced.columns)) == len(replaced.columns)


def test_sentencepiece(spark):
    checked(spark, lambda df, t: sentencepiece_codec.encoded(df, MODEL, t), ["token_ids", "n_tokens", "decoded"])
    df = sentencepiece_codec.encoded(frame(spark, rows()[:3], INTERNAL), MODEL).withColumnRenamed("token_ids", "out")
    assert sentencepiece_codec.decoded(df, MODEL, "out", "out").where("out = text").count() == 3
    assert sentencepiece_codec.decoded(df.limit(0), MODEL, "out").collect() == []


def test_decontamination(spark):
    items = spark.createDataFrame([(1, "in a the")], "item_id int, text string")
    checked(spark, lambda df, t: decontamination.contamination(df, items, t), ["n_words", "n_hit", "n_items", "contaminated"])


def test_license_scan(spark):
    checked(spark, lambda df, t: license_scan.scanned(df, t), ["n_words", "n_base", "labels", "score"])


def test_url_reputation(spark):
    urls = [(i, f"http://h{i % 3}.org/es/{i}" if i else None) for i in range(6)]
    df = frame(spark, urls, INTERNAL).withColumnRenamed("text", "url")
    good = spark.createDataFrame([("http://h1.org/", 1)], "url string, outcome int")
    got = url_reputation.judged(df, good).collect()
    assert all(r[n] == "kept" for r in got for n in INTERNAL.split()) and {r.verdict for r in got} == {"allow"}
    clash = url_reputation.judged(df.withColumnRenamed("url", "host"), good, "host")
    assert sorted((r.doc_id, r.host, r.verdict) for r in clash.collect()) == sorted((r.doc_id, r.host, r.verdict) for r in got)
    assert url_reputation.judged(df.limit(0), good).collect() == []


def test_warc(spark, tmp_path):
    data = [(i, "x" * 2000 if i < 3 else None) for i in range(5)]
    df = frame(spark, data, f"{INTERNAL} record_type REFERS_TO payload_length").select("*", F.encode("text", "utf-8").alias("payload"), F.concat(F.lit("urn:"), F.col("doc_id")).alias("record_id"), F.lit(None).cast("string").alias("target_uri"))
    got = warc.with_revisits(df, "doc_id")
    assert all(r[n] == "kept" for r in got.collect() for n in INTERNAL.split())
    assert {(r.doc_id, r.record_type, r.refers_to, r.payload_length) for r in got.collect()} == {(0, "revisit", "urn:2", 2000), (1, "revisit", "urn:2", 2000), (2, "response", None, 2000), (3, "response", None, 0), (4, "response", None, 0)}
    assert warc.with_revisits(df.limit(0), "doc_id").collect() == []
    warc.archived(got.limit(0), f"file://{tmp_path}/none")
    warc.archived(got, f"file://{tmp_path}/some")
    assert warc.read(spark, f"file://{tmp_path}/some").count() == 5
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


@pytest.mark.parametrize(
    ("apply", "added"),
    [
        (lambda df: toxicity.scored(df, toxicity.Model(("idiot",), (), (), (0.1,) * (toxicity.FEATURES + 1))), ["toxic_score", "toxic_predicted"]),
        (lambda df: pii.with_spans(df), ["pii_spans"]),
    ],
)
def test_columns_of_others_stay(spark, apply, added):
    got = apply(frame(spark, rows()[:5], f"{INTERNAL} {' '.join(added)}"))
    assert got.count() == 5 and all(r[n] == "kept" for r in got.collect() for n in INTERNAL.split()) and len(set(got.columns)) == len(got.columns)


def test_fits_on_null_and_repeated_rows(spark):
    data = rows()[:6] + [(0, None), (0, None), (None, "you idiot")]
    labels = spark.createDataFrame([(0, 1, 0), (0, 1, 0), (1, 0, 1), (2, 1, 1), (None, 1, 1), (9, 0, 0), (3, None, None)], "doc_id bigint, toxic int, quality int")
    docs = frame(spark, data)
    assert len(toxicity.fit(docs, labels).weights) == toxicity.FEATURES + 1
    assert quality_classifier.scored(docs, quality_classifier.fit(docs, labels)).count() == len(data)
    assert quality_rules.judged(docs, quality_rules.fit(docs, labels)).count() == len(data)
    assert set(toxicity.fit(docs.limit(0), labels).weights) == {0.0}
