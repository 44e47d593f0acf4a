"""More queries: column functions, aggregates and small operators over the general test tables, each with the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import mapping, names, timecode
from tidemark.operators import assembly, intervals, library, matching, refining
from tidemark.plans import standins
from tidemark.plans.registry import query
from tidemark.tables import table

# Mappings --------------------------------------------------------------------------------------------------------------

_KNOTS = """k AS (SELECT o_orderkey AS id, unnest([o_orderkey % 7, o_orderkey % 13, o_orderkey % 19 + 5, o_custkey % 23]) AS s, unnest([o_orderkey % 11, o_orderkey % 17, o_orderkey % 23 + 3, o_custkey % 29 + 10]) AS i, unnest([0, 1, 2, 3]) AS n FROM orders),
one AS (SELECT id, s, arg_max(i, n) AS i FROM k GROUP BY ALL),
up AS (SELECT * FROM one QUALIFY coalesce(i > max(i) OVER (PARTITION BY id ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true)),
m AS (SELECT id, list(s ORDER BY s) AS s, list(i ORDER BY s) AS i, count(*) AS n FROM up GROUP BY id)"""


def _knots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    pairs = ((k % 7, k % 11), (k % 13, k % 17), (k % 19 + 5, k % 23 + 3), (c % 23, c % 29 + 10))
    points = F.array(*(F.struct(a.cast("double").alias("source"), b.cast("double").alias("island")) for a, b in pairs))
    return table(spark, sf_dir, "orders").select(k.alias("id"), mapping.normalised(points).alias("p"))


def _text(points):
    return F.array_join(F.transform(points, lambda p: F.concat_ws(":", F.round(p.source, 6).cast("decimal(20,6)"), F.round(p.island, 6).cast("decimal(20,6)"))), " ")


_LIST = "array_to_string([CAST(CAST({0}[x] AS DECIMAL(20,6)) AS VARCHAR) || ':' || CAST(CAST({1}[x] AS DECIMAL(20,6)) AS VARCHAR) FOR x IN range(1, n + 1)], ' ')"


@query("WITH " + _KNOTS + f" SELECT id, {_LIST.format('s', 'i')} AS knots, {_LIST.format('i', 's')} AS inverse, len(list_filter(range(1, n + 1), lambda x: (i[x] - i[1]) <> (s[x] - s[1]))) > 0 AS slips, CASE WHEN n >= 2 THEN n - 1 END AS segments, CASE WHEN n >= 2 THEN CAST(i[n] - i[1] AS DOUBLE) END AS covered FROM m")
def mapping_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knots in order, the inverse, whether they slip, and their segments."""
    s = mapping.segments(F.col("p"))
    k = _knots(spark, sf_dir)
    covered = F.aggregate(s, F.lit(0.0), lambda a, x: a + x.island)
    return k.select("id", _text("p").alias("knots"), _text(mapping.inverted(F.col("p"))).alias("inverse"), mapping.slips_at(F.col("p")).alias("slips"), F.when(s.isNotNull(), F.size(s)).cast("bigint").alias("segments"), covered.alias("covered"))


@query(
    "WITH "
    + _KNOTS
    + """, e AS (SELECT id, s, i, n, unnest([0, 12]) AS x FROM m), b AS (SELECT *, greatest(0, least(len(list_filter(s, lambda v: v <= x)) - 1, n - 2)) + 1 AS a FROM e),
v AS (SELECT id, x, CASE WHEN n = 1 THEN i[1] ELSE i[a] + (x - s[a]) * (i[a + 1] - i[a]) / CAST(s[a + 1] - s[a] AS DOUBLE) END AS y FROM b),
all_ AS (SELECT id, x, y FROM v UNION ALL SELECT id, s, i FROM up WHERE s > 0 AND s < 12), rise AS (SELECT * FROM all_ QUALIFY coalesce(y > max(y) OVER (PARTITION BY id ORDER BY x ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true))
SELECT id, count(*) AS n, round(min(y), 6) AS low, round(max(y), 6) AS high, round(sum(x * y), 4) AS moment FROM rise GROUP BY id"""
)
def anchored_mappings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Knots inside a clip of twelve seconds, with its ends."""
    p = mapping.anchored(F.lit(1.0), F.lit(0.0), F.col("p"), F.lit(12.0))
    k = _knots(spark, sf_dir).select("id", p.alias("p"))
    y = F.transform("p", lambda x: x.island)
    return k.select("id", F.size("p").cast("bigint").alias("n"), F.round(F.array_min(y), 6).alias("low"), F.round(F.array_max(y), 6).alias("high"), F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x.source * x.island), 4).alias("moment"))


# Frames and paths ------------------------------------------------------------------------------------------------------


@query(
    """WITH x AS (SELECT p_partkey AS id, p_retailprice AS t, CASE WHEN p_partkey % 2 = 0 THEN 1001 ELSE 1 END AS v, CASE WHEN p_partkey % 2 = 0 THEN 30000 ELSE 25 END AS ts, p_retailprice * p_size / 8 AS fr, CAST(p_size AS DOUBLE) AS spf FROM part),
g AS (SELECT *, floor(t * ts / v + 0.5) AS n, floor(fr + 0.5) AS near FROM x), y AS (SELECT *, abs(t - n * v / ts) <= 1e-6 AS grid FROM g)
SELECT id, CAST(CASE WHEN grid THEN n * v ELSE floor(t * 1e6 + 0.5) END AS BIGINT) AS value, CAST(CASE WHEN grid THEN ts ELSE 1000000 END AS BIGINT) AS timescale, CAST(floor(t / 0.04) AS BIGINT) AS down, CAST(ceil(t / 0.04) AS BIGINT) AS up,
CASE WHEN v = 1001 THEN 30 * 1000 / CAST(1001 AS DOUBLE) ELSE 25 END::DOUBLE AS fps, CAST(CASE WHEN abs(fr - near) * spf <= 0.5 THEN near ELSE floor(fr) END AS BIGINT) AS whole, CASE WHEN abs(fr - near) * spf <= 0.5 THEN 0 ELSE fr - floor(fr) END AS rest,
CAST(floor((fr - floor(fr)) * 80 + 0.5) AS BIGINT) AS eightieths, CAST(floor(round(t + 0.25, 5) * 25 + 0.5) - CASE WHEN abs(round(t + 0.25, 5) * 25 - floor(round(t + 0.25, 5) * 25) - 0.5) < 1e-9 AND round(t, 5) * 25 < floor(round(t, 5) * 25 + 0.5) THEN 1 ELSE 0 END AS BIGINT) AS shifted FROM y"""
)
def frame_grids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times on frame grids, whole frames and what is left, shifted frames."""
    even = F.col("p_partkey") % 2 == 0
    t, v, ts = F.col("p_retailprice"), F.when(even, 1001).otherwise(1), F.when(even, 30_000).otherwise(25)
    fr = F.col("p_retailprice") * F.col("p_size") / 8
    grid = timecode.grid_time(t, v, ts)
    whole, rest = timecode.snapped(fr, F.col("p_size").cast("double"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), grid["value"].alias("value"), grid["timescale"].alias("timescale"), timecode.whole_frames(t, F.lit(0.04), False).alias("down"), timecode.whole_frames(t, F.lit(0.04), True).alias("up"),
        timecode.sequence_fps(v, ts).alias("fps"), whole.cast("bigint").alias("whole"), rest.alias("rest"), timecode.eightieths(fr - F.floor(fr)).alias("eightieths"), timecode.shifted_frame(F.lit(25.0), t, F.lit(0.25)).alias("shifted"),
    )


@query(
    r"""WITH p AS (SELECT page_id, url, regexp_replace(url, '/[^/]*$', '') AS folder, CASE WHEN page_id % 3 = 0 THEN 'device:Maker:M' || page_id % 5 || ':7' END AS device, CASE WHEN page_id % 3 = 1 THEN 'set' || page_id % 9 END AS span, '/v/' || page_id || CASE page_id % 4 WHEN 0 THEN '/Private/m4root/clip' WHEN 1 THEN '/DCIM/100MSDCF' WHEN 2 THEN '/x/dcim/1000' ELSE '' END AS card,
CASE page_id % 4 WHEN 0 THEN 'V' || page_id % 12 WHEN 1 THEN 'a' || page_id % 12 WHEN 2 THEN 'x1' ELSE 'A' END AS flag FROM pages),
k AS (SELECT *, coalesce(device, 'span:' || span, folder) AS key, string_split(lower(folder), '/') AS f, string_split(lower(replace(folder, 'example', 'Example')) || CASE WHEN page_id % 2 = 0 THEN '' ELSE '/deep' END, '/') AS g FROM p)
SELECT page_id, 'file://' || replace(replace(url_encode(url), '%2F', '/'), '%3A', ':') AS file_url, url AS back, key, CASE WHEN device IS NOT NULL THEN 'M' || page_id % 5 WHEN span IS NOT NULL THEN span ELSE regexp_extract(folder, '([^/]*)$', 1) END AS name,
CASE page_id % 4 WHEN 0 THEN '/v/' || page_id WHEN 1 THEN '/v/' || page_id ELSE card END AS root, CAST(CASE WHEN page_id % 2 = 0 THEN len(f) ELSE 0 END AS BIGINT) AS parents,
CASE WHEN page_id % 4 < 2 AND page_id % 12 >= 1 THEN printf('imported-%s-%06d', CASE WHEN page_id % 4 = 0 THEN 'video' ELSE 'audio' END, page_id % 12 - 1) END AS track, CASE WHEN page_id % 5 > 0 THEN url END AS redirect,
'clip.' || lang || '.' || substr(sha256(len(url) || ':' || url || len(CAST(page_id AS VARCHAR)) || ':' || page_id), 1, 16) || '.wav' AS sidecar, regexp_matches(lower(url), '[^./]\.(wav|mov)$') AS media FROM (SELECT *, 'mono' AS lang FROM k)"""
)
def source_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths as URLs and back, keys and names of sources, roots of cards, folders in common."""
    i, u = F.col("page_id"), F.col("url")
    n = i.cast("string")
    device = F.when(i % 3 == 0, F.concat(F.lit("device:Maker:M"), (i % 5).cast("string"), F.lit(":7")))
    span = F.when(i % 3 == 1, F.concat(F.lit("set"), (i % 9).cast("string")))
    card = F.concat(F.lit("/v/"), n, F.when(i % 4 == 0, "/Private/m4root/clip").when(i % 4 == 1, "/DCIM/100MSDCF").when(i % 4 == 2, "/x/dcim/1000").otherwise(""))
    number = (i % 12).cast("string")
    flag = F.when(i % 4 == 0, F.concat(F.lit("V"), number)).when(i % 4 == 1, F.concat(F.lit("a"), number)).when(i % 4 == 2, "x1").otherwise("A")
    other = F.concat(F.replace(names.folder(u), F.lit("example"), F.lit("Example")), F.when(i % 2 == 0, "/f").otherwise("/deep/f"))
    key, url = names.source_key(u, device, span), names.file_url(u)
    said = F.when(i % 5 > 0, F.concat(F.lit("a="), u)).otherwise(F.lit("=x"))
    return table(spark, sf_dir, "pages").select(
        "page_id", url.alias("file_url"), names.percent_decoded(F.substring(url, 8, 10_000)).alias("back"), key.alias("key"), names.source_name(key).alias("name"), names.card_root(card).alias("root"), names.common_parents(u, other).cast("bigint").alias("parents"),
        names.track_of_flag(flag).alias("track"), names.key_and_value(said)["to"].alias("redirect"), names.sidecar_name(F.lit("clip"), F.lit("mono"), u, n).alias("sidecar"), names.is_media(u).alias("media"),
    )


@query(
    """WITH r(f, t) AS (VALUES ('http://', 'X'), ('https://', '/s/')), p AS (SELECT DISTINCT url AS path FROM pages),
f AS (SELECT DISTINCT regexp_extract(url, '^(https?://[^/?#]+)', 1) AS f, '/m/' || regexp_extract(url, '^https?://([^/?#]+)', 1) AS t FROM pages WHERE page_id % 4 = 0)
SELECT path, CASE WHEN f IS NOT NULL THEN t || substr(path, length(f) + 1) END AS new FROM p LEFT JOIN f ON path = f OR starts_with(path, f || '/')"""
)
def redirected_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths whose hosts are redirected to folders."""
    p = table(spark, sf_dir, "pages")
    host = F.regexp_extract("url", r"^(https?://[^/?#]+)", 1)
    to = F.concat(F.lit("/m/"), F.regexp_extract("url", r"^https?://([^/?#]+)", 1), F.lit("/"))
    rules = p.where("page_id % 4 = 0").select(F.concat(host, F.lit("/")).alias("from"), to.alias("to")).distinct()
    return library.redirected(p.select(F.col("url").alias("path")).distinct(), rules)


# Edges -----------------------------------------------------------------------------------------------------------------

_EDGES = """ed AS (SELECT l_partkey AS l, l_suppkey + 10000000 AS r, max(l_quantity) / 50 AS confidence, count(*) AS anchors, max(l_quantity) AS covered, max(l_tax) AS residual FROM lineitem GROUP BY ALL)"""


@query("WITH " + _EDGES + """, c AS (SELECT *, 1 + anchors / 2.0 AS margin FROM ed), f AS (SELECT l, r, 0.25 * least(1, anchors / 100.0) + 0.2 * least(1, covered / 300.0) + 0.25 * least(1, anchors / greatest(1.0, covered / 2.56) / 0.35)
+ 0.2 * greatest(0, least(1, (0.12 - residual) / 0.1)) + 0.1 * greatest(0, least(1, (margin - 1) / 2)) AS c, confidence >= 0.45 AND anchors >= 3 AND covered >= 3 AND residual <= 0.1 AS usable FROM c)
SELECT l AS "left", r AS "right", round(c, 9) AS confidence, usable FROM f""")
def edge_confidences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Confidences of fits, and which edges are worth refining."""
    e = standins.line_edges(spark, sf_dir)
    usable = matching.usable(e).select("left", "right", F.lit(True).alias("usable"))
    c = matching.confidence(F.col("anchors"), F.col("covered"), F.col("residual"), 1 + F.col("anchors") / 2)
    return e.join(usable, ["left", "right"], "left").select("left", "right", F.round(c, 9).alias("confidence"), F.coalesce("usable", F.lit(False)).alias("usable"))


@query("WITH " + _EDGES + """ SELECT l AS "left", r AS "right" FROM ed WHERE NOT (l % 3 = 0 AND abs(covered - (covered + anchors - 2)) <= 1.5)""")
def rejected_alignments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges whose offset isn't near a rejected one; every other rejection names its pair the other way round."""
    e = standins.line_edges(spark, sf_dir).withColumn("offset", F.col("covered"))
    no = e.where("left % 3 = 0").withColumn("no", F.col("covered") + F.col("anchors") - 2)
    turned = F.col("left") % 2 == 0
    no = no.select(F.when(turned, F.col("right")).otherwise(F.col("left")).alias("left"), F.when(turned, F.col("left")).otherwise(F.col("right")).alias("right"), F.when(turned, -F.col("no")).otherwise(F.col("no")).alias("offset"))
    return matching.without_rejected_alignments(e, no).select("left", "right")


@query(
    r"""WITH d AS (SELECT doc_id, len(list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> '')) AS n FROM documents) SELECT 2 * doc_id AS "left", 2 * doc_id + 1 AS "right", 1.01::DOUBLE AS rate, CAST(n AS BIGINT) AS landmarks FROM d WHERE n >= 1300"""
)
def drifting_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two recordings of each long document, one by a clock that is a hundredth faster: votes have no clear winner, the ridge has the
    rate. A landmark is a word's place, eight frames apart."""
    words = standins.tokens(F.col("text"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.size(words).alias("n")).where("n >= 1300")
    each = docs.withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).withColumn("k", F.explode(F.array(F.lit(0), F.lit(1))))
    frame = F.when(F.col("k") == 0, 8 * F.col("i")).otherwise(F.round(1.01 * 8 * F.col("i")) + 100).cast("int")
    landmarks = each.select((2 * F.col("doc_id") + F.col("k")).alias("clip"), F.xxhash64("doc_id", "i").alias("hash"), frame.alias("frame"))
    e = matching.matched(landmarks, docs.agg((2 * F.count(F.lit(1))).alias("n")))
    return e.join(docs.select((2 * F.col("doc_id")).alias("left"), F.col("n").cast("bigint").alias("landmarks")), "left").select("left", "right", F.round("rate", 3).alias("rate"), "landmarks")


@query("WITH " + _EDGES + """, s AS (SELECT CASE WHEN l = 5 THEN r ELSE l END AS clip, CASE WHEN l = 5 THEN covered ELSE -covered END AS "offset", confidence FROM ed WHERE l = 5 OR r = 5)
SELECT clip, "offset", confidence, s_name AS name FROM s JOIN supplier ON s_suppkey + 10000000 = clip""")
def correction_options(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a clip's place could be corrected by."""
    known = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("clip"), F.col("s_name").alias("name"))
    return library.correction_options(standins.line_edges(spark, sf_dir).withColumn("offset", F.col("covered")), 5, known)


# Media, islands, results -----------------------------------------------------------------------------------------------


@query("""SELECT o_orderkey AS edit, o_orderkey % 6 AS channel FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_orderkey % 4 <> 0 AND o_orderkey % 6 >= c_nationkey % 5""")
def bad_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits that name a channel which their clip doesn't have."""
    k = F.col("o_orderkey")
    edits = table(spark, sf_dir, "orders").select(k.alias("edit"), F.col("o_custkey").alias("clip"), F.when(k % 4 != 0, k % 6).alias("channel"))
    clips = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip"), (F.col("c_nationkey") % 5).alias("channels"))
    return library.bad_channels(edits, clips).select("edit", "channel")


@query("""SELECT DISTINCT o_custkey AS clip, 'a' || o_orderkey % 3 AS asset, substr(sha256(o_custkey || chr(0) || 'a' || o_orderkey % 3), 1, 16) AS job FROM orders""")
def render_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One job for each clip and asset."""
    return library.render_jobs(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("clip"), F.concat(F.lit("a"), (F.col("o_orderkey") % 3).cast("string")).alias("asset")))


@query("""SELECT c_name AS path, CASE c_custkey % 3 WHEN 0 THEN 'Variable frame rate: timing may drift.' ELSE 'Frame rate mode is not known.' END AS message FROM customer WHERE c_custkey % 3 < 2""")
def frame_rate_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Warnings of clips whose frame rate varies or isn't known."""
    m = F.col("c_custkey") % 3
    return library.frame_rate_warnings(table(spark, sf_dir, "customer").select(F.col("c_name").alias("path"), F.when(m == 0, "variable").when(m == 1, "unknown").otherwise("constant").alias("rate_mode")))


@query("SELECT DISTINCT path FROM (SELECT url AS path FROM pages UNION ALL SELECT c_name FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_name FROM customer) WHERE path IS NOT NULL")
def distinct_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H2: paths of several tables, once each."""
    c = table(spark, sf_dir, "customer")
    return library.distinct_urls(table(spark, sf_dir, "pages").select(F.col("url").alias("path")), c.where("c_custkey % 2 = 0").select(F.col("c_name").alias("path")), c.select(F.col("c_name").alias("path")))


_ITEMS = """it AS (SELECT o_custkey AS island, o_orderkey AS id, CAST(o_orderkey % 50 AS DOUBLE) AS s, CASE WHEN o_custkey % 3 = 0 THEN CAST(o_orderkey % 50 + o_custkey AS DOUBLE) + o_orderkey % 2 * (o_custkey % 2) * 3 END AS rec, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderkey % 50 + 7 AS DOUBLE) END AS tc FROM orders)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    s = (k % 50).cast("double")
    return table(spark, sf_dir, "orders").select(c.alias("island"), k.alias("id"), s.alias("start"), (s + 1).alias("end"), F.when(c % 3 == 0, s + c + k % 2 * (c % 2) * 3).alias("recorded"), F.when(k % 2 == 0, s + 7).alias("tc"))


@query("WITH " + _ITEMS + """, d AS (SELECT island, CASE WHEN count(rec) = 1 OR max(rec - s) - min(rec - s) <= 2 THEN quantile_cont(rec - s, 0.5) END AS r, CASE WHEN count(tc) = 1 OR max(tc - s) - min(tc - s) <= 2 THEN quantile_cont(tc - s, 0.5) END AS t FROM it GROUP BY island)
SELECT island, CASE WHEN r IS NOT NULL THEN 0 WHEN t IS NOT NULL THEN 1 ELSE 2 END AS kind, coalesce(r, t, CAST(island AS DOUBLE)) AS origin FROM d""")
def chronologies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What islands are ordered by: dates that agree, timecodes that agree, or their number."""
    return assembly.chronology(_items(spark, sf_dir))


@query("WITH " + _ITEMS + ", sh AS (SELECT island, min(s) AS shift FROM it GROUP BY island) SELECT island, id, s - shift AS start, s + 1 - shift AS \"end\" FROM it JOIN sh USING (island)")
def combined_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K4: items moved by their island's shift."""
    i = _items(spark, sf_dir).withColumn("project", F.lit(0))
    shifts = i.groupBy("project", "island").agg((-F.min("start")).alias("shift"))
    return assembly.combined(i, shifts).select("island", "id", "start", "end")


@query("""WITH p AS (SELECT c_custkey AS clip, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END AS island, CAST(c_custkey % 77 - 40 AS DOUBLE) AS d FROM customer)
SELECT count(DISTINCT island) AS islands, count(island) AS placed, CAST(sum(CASE WHEN island IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS unmatched, max(abs(d)) AS drift_ppm, (SELECT count(*) FROM supplier) AS warnings FROM p""")
def result_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result in figures."""
    c = F.col("c_custkey")
    p = table(spark, sf_dir, "customer").select(c.alias("clip"), F.when(c % 3 > 0, F.col("c_nationkey")).alias("island"), (c % 77 - 40).cast("double").alias("drift_ppm"))
    return assembly.summary(p, table(spark, sf_dir, "supplier"))


@query("SELECT c_custkey AS clip FROM customer WHERE c_custkey % 4 = 2")
def selected_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K8: the rows of one stage."""
    return assembly.select_stage(table(spark, sf_dir, "customer").select((F.col("c_custkey") % 4).alias("stage"), F.col("c_custkey").alias("clip")), 2).select("clip")


@query("SELECT CAST(min(c_acctbal) AS DOUBLE) AS ruler FROM customer WHERE c_custkey % 2 = 0")
def ruler_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the ruler begins: the earliest timecode."""
    return intervals.ruler_start(table(spark, sf_dir, "customer").select(F.when(F.col("c_custkey") % 2 == 0, "timecode").otherwise("order").alias("kind"), F.col("c_acctbal").alias("start")))


@query(
    """WITH c AS (SELECT c_custkey AS clip, CASE WHEN c_custkey % 3 > 0 THEN c_nationkey END AS island, c_acctbal AS o FROM customer), l AS (SELECT coalesce(max(island) + 1, 0) AS n FROM c)
SELECT clip, CAST(island AS BIGINT) AS island, o AS start, o + 2 AS "end", true AS synced FROM c WHERE island IS NOT NULL UNION ALL SELECT clip, n + row_number() OVER (ORDER BY clip) - 1, 0.0, 2.0, false FROM c, l WHERE island IS NULL"""
)
def assembled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items of all islands, and each unmatched clip as one of its own behind them: the bars that are drawn."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    clips = c.select(k.alias("clip"), F.lit("audio").alias("kind"), F.lit(2.0).alias("duration"), F.lit("s").alias("source"))
    placed = c.where(k % 3 > 0).select(k.alias("clip"), F.col("c_nationkey").cast("bigint").alias("island"), F.col("c_acctbal").alias("offset"), F.lit(1.0).alias("rate"), F.lit(0.9).alias("confidence"))
    return assembly.assembled(placed, clips).select("clip", "island", "start", "end", "synced")


@query(
    """WITH e AS (SELECT o_orderkey AS edit, o_custkey AS clip, o_orderkey % 3 AS t, CAST(o_orderkey % 9 AS DOUBLE) AS src, CAST(o_orderkey % 100 AS DOUBLE) AS st, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey % 4 END AS linked FROM orders),
s(k, shift) AS (VALUES ('imported-audio-000000', 1.5::DOUBLE), ('imported-audio-000001', -2.0::DOUBLE), ('imported-audio-000003', 4.0::DOUBLE)), c AS (SELECT c_custkey AS clip, CAST(c_custkey % 12 AS DOUBLE) AS d FROM customer)
SELECT 'imported-audio-' || edit AS instance, clip, s.k AS track, st + s.shift AS start, src AS source_in, least(src + 5, d) AS source_out, 4.0::DOUBLE AS length, CASE WHEN linked IS NOT NULL THEN st + coalesce(a.shift, s.shift) END AS linked_start
FROM e JOIN c USING (clip) JOIN s ON s.k = printf('imported-audio-%06d', t) LEFT JOIN s a ON a.k = printf('imported-audio-%06d', linked)"""
)
def placed_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Imported edits on the new timeline, and sound that is linked to them."""
    k = F.col("o_orderkey")
    st = (k % 100).cast("double")
    src = (k % 9).cast("double")
    e = table(spark, sf_dir, "orders").select(k.alias("edit"), F.col("o_custkey").alias("clip"), F.lit("audio").alias("media"), (k % 3).alias("track_index"), src.alias("source_in"), (src + 5).alias("source_out"), st.alias("timeline_start"), (st + 4).alias("timeline_end"), F.when(k % 5 == 0, k % 4).alias("linked_index"))
    shifts = spark.createDataFrame([("imported-audio-000000", 1.5), ("imported-audio-000001", -2.0), ("imported-audio-000003", 4.0)], "track string, shift double")
    clips = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip"), (F.col("c_custkey") % 12).cast("double").alias("duration"))
    return assembly.placed_edits(e, shifts, clips)


# Sound -----------------------------------------------------------------------------------------------------------------

_TAPES = f"""sc AS (SELECT doc_id // {standins.PER_TAPE} AS scene, sum(octet_length(encode(text))) AS n FROM documents WHERE text IS NOT NULL GROUP BY ALL HAVING sum(octet_length(encode(text))) >= {standins.LEAST_TAPE})"""


@query("WITH " + _TAPES + f""" SELECT scene * 10 AS "left", scene * 10 + k AS "right", CAST(-s AS BIGINT) AS samples FROM sc, (VALUES (1, {standins.SHIFTS[1]}), (2, {standins.SHIFTS[2]})) AS t(k, s)""")
def refined_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """G9 with G6, G8, G10, F8: of three takes of each tape, which begin at different bytes of its documents, the coarse edges between the first
    and the others as the sound has them, to a sample; the weak edge between those closes a circle and goes."""
    sound = standins.tapes(spark, sf_dir)
    done = refining.refined(standins.tape_edges(spark, sf_dir, 0.05), sound, size=standins.TAPE_BLOCK)
    return done.select("left", "right", F.round(F.col("offset") * 16_000).cast("bigint").alias("samples"))


@query("WITH " + _TAPES + f""" SELECT scene * 10 AS "left", scene * 10 + k AS "right", CAST(w AS INTEGER) AS k, CAST(-800 AS BIGINT) AS samples FROM sc, (VALUES (1), (2)) AS t(k), range(15) AS r(w)""")
def audited_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the coarse edges of those takes are off, window by window: 50 ms, or 800 samples."""
    sound = standins.tapes(spark, sf_dir)
    done = refining.audited(standins.tape_edges(spark, sf_dir, 0.05).where("confidence > 0.8"), sound, size=standins.TAPE_BLOCK)
    return done.select("left", "right", "k", F.round(F.col("error") * 16_000).cast("bigint").alias("samples"))


@query(
    """SELECT l_suppkey, round(regr_slope(l_extendedprice, l_quantity), 6) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(sqrt(greatest(0, regr_syy(l_extendedprice, l_quantity) - regr_slope(l_extendedprice, l_quantity) * regr_sxy(l_extendedprice, l_quantity)) / count(*)), 3) AS residual FROM lineitem GROUP BY 1"""
)
def line_fits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of least squares, and what they leave."""
    f = assembly.line_fit("l_quantity", "l_extendedprice")
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(f.alias("f")).select("l_suppkey", F.round("f.slope", 6).alias("slope"), F.round("f.intercept", 4).alias("intercept"), F.round("f.residual", 3).alias("residual"))
