"""The queries of this subpackage and, where SQL can express one, the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontamination, fill_in_middle, grouped_ranking, jaccard_join, language_model, license_scan, pii, quality_classifier, quality_rules, sentencepiece_codec, toxicity, url_reputation, warc
from tidemark.llm.shared import scratch, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontamination.contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.encode(F.array_join("items", ","), "utf-8"), 256).alias("items_sha256"), "contaminated")


def op2_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    done = url_reputation.judged(pages, url_reputation.labelled(pages, table(spark, sf_dir, "labels")))
    return done.select("page_id", "host", "path", "rule", "verdict")


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = sentencepiece_codec.model_bytes(public_tokenizers.path("piece_bpe_32k.model"))
    done = sentencepiece_codec.encoded(table(spark, sf_dir, "documents").select("doc_id", "text"), model)
    return done.select("doc_id", "n_tokens", F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))).alias("record_id"), F.col("url").alias("target_uri"), F.encode("html", "utf-8").alias("payload"))
    path = scratch(spark, "warc")
    warc.archived(warc.with_revisits(pages, "page_id"), path)
    back = warc.read(spark, path)

    def number(record_id: str):
        return F.expr(f"try_cast(nullif(substring({record_id}, {len('urn:page:') + 1}), '') AS BIGINT)")

    # What a response holds is measured anew; a revisit has only what its headers say.
    digest = F.when(F.col("record_type") == "response", F.sha1("payload")).otherwise(F.col("payload_digest"))
    return back.select(number("record_id").alias("page_id"), F.col("payload_length").alias("payload_bytes"), digest.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scanned(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op7_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.linked(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", F.col("component").alias("component_id"))


def fold(of: int):
    """Remainder of crc32(doc_id as text), by which rows are held out; -1 without an id, so such rows are not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % of, F.lit(-1).cast("long"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, table(spark, sf_dir, "labels").where(fold(5) != 0))
    done = toxicity.scored(docs.select("doc_id", (fold(5) == 0).alias("held_out"), "text"), model)
    return done.select("doc_id", "held_out", F.col("toxic_score").alias("score"), F.col("toxic_predicted").alias("predicted"))


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality_classifier.fit(docs, table(spark, sf_dir, "labels").where(fold(3) != 1))
    done = quality_classifier.scored(docs.select("doc_id", (fold(3) == 1).alias("held_out"), "text"), model)
    return done.select("doc_id", "held_out", F.col("quality_score").alias("score"), F.col("quality_predicted").alias("predicted"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = pii.with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("pii_spans", lambda x: x.kind.isin(*pii.BASE))

    def listed(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x.kind, x.start, x.end)), ",")

    def count(kind):
        return F.size(F.filter("pii_spans", lambda x: x.kind == kind)).cast("long").alias(f"n_{kind}")

    counts = [count(k) for k in pii.BASE]
    return done.select("doc_id", *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed("pii_spans").alias("spans"), F.size("pii_spans").cast("long").alias("n_spans"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    done = quality_rules.judged(docs, quality_rules.fit(docs, table(spark, sf_dir, "labels")))
    return done.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = fill_in_middle.unfilled(fill_in_middle.filled(table(spark, sf_dir, "documents").select("doc_id", "text"), keep_text=False))
    prefix, middle, n = (F.col(f"fim_{x}") for x in ("prefix_chars", "middle_chars", "units"))

    def digest(c: str):
        return F.sha2(F.encode(c, "utf-8"), 256)

    return done.select("doc_id", n.alias("n"), F.col("fim_form").alias("form"), prefix.alias("prefix_chars"), middle.alias("middle_chars"), digest("fim_output").alias("output_sha256"), digest("fim_restored").alias("restored_sha256"))


def op12_grouped_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "sale_lines").select("sale_id", "line_no", "item_id", "vendor_id", "quantity", "amount", "discount", "shipped_at")
    one = F.coalesce(F.crc32(F.col("sale_id").cast("string")) % 5 == 0, F.lit(False))

    def dealt(c):
        return F.when(one, F.lit(-1)).otherwise(c).cast("long")

    lines = lines.select(
        dealt(F.col("vendor_id")).alias("vendor_id"), dealt(F.coalesce(F.col("item_id") % 2, F.lit(-1))).alias("part"), dealt(F.coalesce(100 * F.year("shipped_at") + F.month("shipped_at"), F.lit(-1))).alias("month"),
        F.col("sale_id").cast("long"), F.col("line_no").cast("long"), F.col("quantity").cast("long"), F.floor(100 * F.col("discount") + 0.5).cast("long").alias("percent"), F.floor(100 * F.col("amount") + 0.5).cast("long").alias("amount_cents"),
        F.floor(F.col("quantity") / 10).cast("long").alias("tens"),
    )
    done = grouped_ranking.ranked(lines, ["vendor_id", "part", "month"], "tens", "percent", ["sale_id", "line_no", "quantity", "amount_cents"], 5)
    return done.select("vendor_id", "part", "month", "pos", "place", "sale_id", "line_no", "quantity", "percent", "amount_cents", "tied")


def op13_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", (fold(5) == 1).alias("held_out"), "text")
    done = language_model.scored(docs, ~F.col("held_out"), keep_text=False)
    return done.select("doc_id", "held_out", *(F.col(f"lm_{x}").alias(n) for x, n in (("tokens", "n_tokens"), ("known", "n_known"), ("train_tokens", "train_tokens"), ("base_score", "base_score"), ("score", "score"))))


#: The same of `pages`, without archives.
WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS n FROM pages),
d AS (SELECT *, sha1(html) AS digest FROM p),
k AS (SELECT digest, max(page_id) AS kept FROM d WHERE n >= {warc.REVISIT_BYTES} GROUP BY digest HAVING count(*) > 1 AND max(page_id) IS NOT NULL)
SELECT page_id, n AS payload_bytes, digest AS payload_digest, CASE WHEN kept IS NOT NULL AND page_id IS DISTINCT FROM kept THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN page_id IS DISTINCT FROM kept THEN kept END AS refers_to FROM d LEFT JOIN k USING (digest)
"""


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_decontamination, op2_url_reputation, op3_sentencepiece, op4_toxicity, op5_warc, op6_license_scan, op7_jaccard_join, op8_quality_classifier, op9_pii, op10_quality_rules, op11_fill_in_middle, op12_grouped_ranking, op13_language_model)}


def oracle_sql() -> dict[str, str]:
    return {"op1_decontamination": decontamination.SQL, "op2_url_reputation": url_reputation.sql(), "op5_warc": WARC_SQL, "op7_jaccard_join": jaccard_join.SQL, "op11_fill_in_middle": fill_in_middle.SQL, "op12_grouped_ranking": grouped_ranking.SQL}
