"""Benchmark decontamination by winnowing, with DataFrame functions only.

A text's k-gram hashes are winnowed: of every `SPAN - K + 1` neighbouring ones the least is kept. Two texts that share SPAN
words in a row share that stretch's hashes and so its least one: no shared stretch of SPAN words goes unnoticed. Document
and benchmark fingerprints are joined, and each match is extended word by word: a window that holds the k-gram begins at
most SPAN - K words before it, so a fingerprint's entry in the index carries those words and as many behind it, however long
its item is. The extension also undoes any collision of hashes. Items of fewer than SPAN words are one window; their first
k-gram, with a smaller k for very short ones, is sought among all of a document's. All lengths are sought in one pass.

The index goes to all executors only while it has at most `BROADCAST_ROWS` entries and `BROADCAST_BYTES` of words; beyond it
the join shuffles bare fingerprints, and only documents with a match are read again. (`explode_outer` stands where
`explode` would do: for the latter the optimiser adds a filter that works out the exploded array a second time, in one
expression with all that it is made of.)
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import aside, back, lower_ascii, settled, split_words, without

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
SPAN, K = 10, 5
BROADCAST_ROWS, BROADCAST_BYTES = 100_000, 32_000_000
#: Keys of texts (32 bytes each) that go to all tasks, at most, with BROADCAST_BYTES of item ids; beyond it texts are shuffled.
BROADCAST_KEYS = 500_000
ADDED = ("n_words", "n_hit", "n_items", "items", "contaminated")


def words(text: Column) -> Column:
    """Words of the text with A-Z lower-cased; null has none."""
    return split_words(lower_ascii(text))


def _grams(w: str, k: int) -> Column:
    n = F.size(w)
    grams = F.transform(F.sequence(F.lit(0), n - k), lambda i: F.xxhash64(*(F.get(F.col(w), i + j) for j in range(k)))) if k > 1 else F.transform(w, lambda x: F.xxhash64(x))
    return F.when(n >= k, grams).otherwise(F.array().cast("array<bigint>"))


def _least(h: str, window: int) -> Column:
    """The least of every `window` neighbouring hashes, each once."""
    least = F.transform(F.sequence(F.lit(0), F.size(h) - window), lambda i: F.least(*(F.get(F.col(h), i + j) for j in range(window))))
    return F.array_distinct(F.when(F.size(h) >= window, least).otherwise(F.array().cast("array<bigint>")))


def _places(h: Column, fp: Column) -> Column:
    return F.filter(F.transform(h, lambda x, i: F.when(x == fp, i)), lambda i: i.isNotNull())


def index_of(items: DataFrame) -> DataFrame:
    """items: item, w. The index (fp, item, k, back, near, need): a k-gram's hash, the words near it of which `back` stand before it,
    and how many in a row have to agree. An item of SPAN words or more has an entry for each place of a kept hash, a shorter one a
    single entry."""
    long = items.where(F.size("w") >= SPAN).withColumn("h", _grams("w", K))
    long = long.select("item", "w", "h", F.explode_outer(_least("h", SPAN - K + 1)).alias("fp")).select("item", "w", "fp", F.explode_outer(_places(F.col("h"), F.col("fp"))).alias("q"))
    long = long.withColumn("back", F.least("q", F.lit(SPAN - K)))
    long = long.select("fp", "item", F.lit(K).alias("k"), "back", F.slice("w", F.col("q") - F.col("back") + 1, F.col("back") + SPAN).alias("near"), F.lit(SPAN).alias("need"))
    short = items.where(F.size("w") < SPAN).withColumn("k", F.least(F.size("w"), F.lit(K)))
    first = F.lit(None).cast("bigint")
    for k in range(1, K + 1):
        first = F.when(F.col("k") == k, F.xxhash64(*(F.get("w", F.lit(j)) for j in range(k)))).otherwise(first)
    short = short.select(first.alias("fp"), "item", "k", F.lit(0).alias("back"), F.col("w").alias("near"), F.size("w").alias("need"))
    return long.union(short)


def _hits(docs: DataFrame, index: DataFrame) -> DataFrame:
    """docs: key, w. (key, item, at): positions of the document's words that occurrences of the item's windows cover."""
    size = index.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.array_join("near", " ")) + 100).alias("b"), F.max(F.col("need") >= SPAN).alias("long")).first()
    short = sorted(r.k for r in index.where(F.col("need") < SPAN).select("k").distinct().collect())  # 1 to K
    sought = sorted({K, *short})
    found = docs.withColumns({f"h{k}": _grams("w", k) for k in sought})
    kept = _least(f"h{K}", SPAN - K + 1) if size.long else F.array().cast("array<bigint>")
    for k in short:
        kept = F.array_union(kept, F.col(f"h{k}"))
    found = found.withColumn("fps", kept)
    hashes = [f"h{k}" for k in sought]
    if size.n <= BROADCAST_ROWS and (size.b or 0) <= BROADCAST_BYTES:
        met = found.select("key", "w", *hashes, F.explode_outer("fps").alias("fp")).join(F.broadcast(index), "fp")
    else:
        met = settled(found.select("key", F.explode_outer("fps").alias("fp")).distinct().join(index, "fp"), "met")
        keys = met.select("key").distinct()
        few = F.broadcast if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else (lambda x: x)
        met = met.join(found.join(few(keys), "key", "left_semi").select("key", "w", *hashes).dropDuplicates(["key"]), "key")
    h = F.col(f"h{sought[-1]}")
    for k in sought[:-1]:
        h = F.when(F.col("k") == k, F.col(f"h{k}")).otherwise(h)
    met = met.select("key", "w", "item", "near", "need", "back", F.explode_outer(_places(h, F.col("fp"))).alias("p")).withColumn("shift", F.col("p") - F.col("back"))
    same = F.transform("near", lambda x, j: F.coalesce((F.col("shift") + j >= 0) & (F.get("w", F.col("shift") + j) == x), F.lit(False)))
    same = met.withColumn("same", same)
    runs = F.transform(F.sequence(F.lit(0), F.size("near") - F.col("need")), lambda j: F.when(F.forall(F.slice("same", j + 1, F.col("need")), lambda x: x), F.sequence(F.col("shift") + j, F.col("shift") + j + F.col("need") - 1)))
    return same.select("key", "item", F.array_distinct(F.flatten(F.filter(runs, lambda x: x.isNotNull()))).alias("at")).where(F.size("at") > 0)


def _by_text(docs: DataFrame, benchmark: DataFrame, text: str, item_id: str, item_text: str) -> DataFrame:
    """(key, n_hit, items) of texts with a hit; key is the text's MD5."""
    items = benchmark.where(F.col(item_id).isNotNull()).select(F.col(item_id).cast("string").alias("item"), words(F.col(item_text)).alias("w")).where(F.size("w") > 0)
    texts = docs.where(docs[f"`{text}`"].isNotNull()).select(F.md5(F.encode(docs[f"`{text}`"], "utf-8")).alias("key"), words(docs[f"`{text}`"]).alias("w"))
    by_text = _hits(texts, settled(index_of(items), "index")).groupBy("key").agg(F.collect_set("at").alias("at"), F.collect_set("item").alias("items"))
    return by_text.select("key", F.size(F.array_distinct(F.flatten("at"))).cast("long").alias("n_hit"), F.sort_array("items").alias("items"))


def _hit_texts(*args) -> DataFrame:
    """The texts with a hit, written out: sent to all tasks while there are at most BROADCAST_KEYS with BROADCAST_BYTES of ids, so
    that no copies of one text meet in a task; beyond it the engine can split the rows of a text."""
    hit = settled(_by_text(*args), "hit")
    size = hit.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(F.array_join("items", ","))).alias("b")).first()
    return F.broadcast(hit) if size.n <= BROADCAST_KEYS and (size.b or 0) <= BROADCAST_BYTES else hit


def contamination(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs with n_words, n_hit (words inside an occurrence of an item's window), n_items, items (ids as sorted strings) and
    contaminated (n_hit > 0).

    A row out for each row in: rows with equal texts are worked out once. Null and empty texts have no words and no hit.
    Items without an id or without words are ignored; an id that is repeated counts once. Columns of docs with the names of
    the added ones are replaced. Either table may be empty.
    """
    names = without(docs, ADDED).columns
    by_text = _hit_texts(docs, benchmark, text, item_id, item_text)
    own = docs[f"`{text}`"]
    done = docs.select(*aside(docs, names), F.md5(F.encode(own, "utf-8")).alias("key"), F.size(split_words(own)).cast("long").alias("n_words")).join(by_text, "key", "left")
    items, n_hit = F.coalesce("items", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0).cast("long"))
    return done.select(*back(names), "n_words", n_hit.alias("n_hit"), F.size(items).cast("long").alias("n_items"), items.alias("items"), (n_hit > 0).alias("contaminated"))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """docs less the contaminated rows; the rest as it is, repeated rows, null and empty texts included. Texts aren't shuffled while
    at most BROADCAST_KEYS texts have a hit."""
    hit = settled(_by_text(docs, benchmark, text, item_id, item_text).select("key"), "hit")
    few = F.broadcast(hit) if hit.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else hit
    return docs.join(few, F.md5(F.encode(docs[f"`{text}`"], "utf-8")) == few["key"], "left_anti")


SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}'), []) AS w FROM documents),
i AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
iw AS (SELECT item, least(len(w), {SPAN}) AS m, unnest(generate_series(1, len(w) - least(len(w), {SPAN}) + 1)) AS p, w FROM i WHERE len(w) > 0),
win AS (SELECT DISTINCT item, m, array_to_string(w[p:p + m - 1], ' ') AS s FROM iw),
ms AS (SELECT DISTINCT m FROM win),
dw AS (SELECT r, m, unnest(generate_series(1, len(w) - m + 1)) AS p, w FROM d, ms WHERE len(w) >= m),
hit AS (SELECT r, p, dw.m AS m, item FROM dw JOIN win ON win.m = dw.m AND win.s = array_to_string(w[p:p + dw.m - 1], ' ')),
pos AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + m - 1)) AS q FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
sha256(coalesce(s, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
"""
