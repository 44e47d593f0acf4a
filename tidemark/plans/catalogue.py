"""Queries over the general test tables, one or more for each family of operators, and the same in DuckDB's SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark import schema as S
from tidemark.functions import evidence, mapping, names, timecode
from tidemark.operators import assembly, graph, intervals, lanes, library, matching, order, policies, signal, spans
from tidemark.plans import measures, standins  # noqa: F401: measures enters more queries
from tidemark.plans.registry import QUERIES, SQL, query  # noqa: F401
from tidemark.sources import fingerprints
from tidemark.streaming import live
from tidemark.tables import settled, table

EPOCH_MICROS = "timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)"


# Coarse matching -------------------------------------------------------------------------------------------------------

_LANDMARKS = r"""t AS (SELECT doc_id AS clip, list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> '') AS w FROM documents),
lm AS (SELECT clip, i - 1 AS frame, {hash} AS hash FROM (SELECT clip, w, unnest(generate_series(1, len(w) - 2)) AS i FROM t WHERE len(w) >= 3)),
cap AS (SELECT hash FROM lm GROUP BY hash HAVING count(*) BETWEEN 2 AND (SELECT greatest(48, CAST(floor(count(*) * 2.2) AS BIGINT)) FROM documents)),
sh AS (SELECT lm.* FROM lm JOIN cap USING (hash)),
pr AS (SELECT l.clip AS "left", r.clip AS "right", l.hash, l.frame AS lf, r.frame AS rf FROM sh l JOIN sh r ON l.hash = r.hash AND l.clip < r.clip),
votes AS (SELECT "left", "right", CAST(floor((rf - lf) / 8.0) AS BIGINT) AS bucket, count(*) AS votes FROM pr GROUP BY ALL),
win AS (SELECT "left", "right", bucket AS winner, votes FROM votes QUALIFY row_number() OVER (PARTITION BY "left", "right" ORDER BY votes DESC, bucket) = 1),
best AS (SELECT win."left", win."right", winner, win.votes, coalesce(max(v.votes) FILTER (WHERE abs(v.bucket - winner) > 2), 0) AS runner_up FROM win JOIN votes v ON v."left" = win."left" AND v."right" = win."right" WHERE win.votes >= 12 GROUP BY ALL),
clear AS (SELECT * FROM best WHERE NOT (runner_up >= 12 AND votes / CAST(greatest(runner_up, 1) AS DOUBLE) < 1.35))"""
_PLAIN = "WITH " + _LANDMARKS.replace("{hash}", "w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]")
_NAMED = "WITH " + _LANDMARKS.replace("{hash}", "CAST('0x' || substr(md5(w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]), 1, 15) AS BIGINT)")


@query(_PLAIN + '\nSELECT "left", "right", CAST(winner AS BIGINT) AS bucket, CAST(votes AS BIGINT) AS votes, CAST(runner_up AS BIGINT) AS runner_up FROM clear')
def best_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents that share runs of words, by how they lie to each other."""
    best = matching.best_offsets(standins.doc_landmarks(spark, sf_dir), standins.doc_count(spark, sf_dir))
    return best.select("left", "right", F.col("winner").alias("bucket"), "votes", "runner_up")


def _votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    shared = settled(matching.shared_landmarks(settled(standins.doc_landmarks(spark, sf_dir), "landmarks"), standins.doc_count(spark, sf_dir)), "shared")
    return settled(matching.strong_votes(shared), "votes")


@query(
    _PLAIN
    + """,
peak AS (SELECT *, max(votes) OVER (PARTITION BY "left", "right" ORDER BY bucket RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS top FROM votes),
near AS (SELECT *, abs(bucket * 0.512 - ("left" + "right") % 40) AS error FROM peak WHERE votes >= 12 AND votes = top),
rk AS (SELECT *, row_number() OVER o AS rn, lead(error) OVER o AS following FROM near WINDOW o AS (PARTITION BY "left", "right" ORDER BY error, votes DESC, bucket))
SELECT "left", "right", bucket AS winner, CAST(votes AS BIGINT) AS votes FROM rk WHERE rn = 1 AND error <= 2 AND (following IS NULL OR following - error >= 5)"""
)
def hinted_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Peaks that metadata points to."""
    votes = _votes(spark, sf_dir)
    hints = votes.select("left", "right").distinct().withColumn("expected", ((F.col("left") + F.col("right")) % 40).cast("double"))
    return matching.hinted(votes, hints)


@query(_PLAIN + """ SELECT DISTINCT "left", "right" FROM (SELECT "left", "right", bucket, lag(bucket, 5) OVER (PARTITION BY "left", "right" ORDER BY bucket) AS fifth FROM votes WHERE votes >= 12) WHERE bucket - fifth = 5""")
def ridge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs whose votes lie along a slope."""
    return matching.ridge_candidates(_votes(spark, sf_dir))


@query(
    _NAMED
    + """,
el AS (SELECT pr.*, lf // 40 AS cell FROM pr JOIN clear c ON c."left" = pr."left" AND c."right" = pr."right" WHERE floor((rf - lf) / 8.0) BETWEEN winner - 2 AND winner + 2)
SELECT "left", "right", CAST(cell AS BIGINT) AS cell, CAST(lf AS BIGINT) AS lf, CAST(rf AS BIGINT) AS rf FROM el QUALIFY row_number() OVER (PARTITION BY "left", "right", cell ORDER BY hash DESC, lf DESC, rf DESC) = 1"""
)
def match_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C4: one anchor for each stretch of a matched pair."""
    shared = settled(matching.shared_landmarks(settled(standins.doc_landmarks(spark, sf_dir, named=True), "landmarks"), standins.doc_count(spark, sf_dir)), "shared")
    chosen = matching.guarded(matching.winners(matching.strong_votes(shared))).where("clear")
    return matching.anchors(shared, chosen.select("left", "right", "winner")).select("left", "right", F.col("cell").cast("bigint"), F.col("lf").cast("bigint"), F.col("rf").cast("bigint"))


@query()
def match_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C1 with C4, C8, C9: edges with robust fits. (Fits are numpy: held against literal cases in the tests.)"""
    return matching.matched(standins.doc_landmarks(spark, sf_dir), standins.doc_count(spark, sf_dir)).drop("points")


@query(
    r"""WITH t AS (SELECT doc_id // 4 AS clip, doc_id % 4 AS stream, list_filter(string_split_regex(text, '[ \t\r\n]+'), lambda x: x <> '') AS w FROM documents),
lm AS (SELECT clip, stream, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS hash FROM (SELECT clip, stream, w, unnest(generate_series(1, len(w) - 2)) AS i FROM t WHERE len(w) >= 3)),
sh AS (SELECT hash FROM lm GROUP BY hash HAVING count(DISTINCT clip) > 1),
h AS (SELECT clip, stream, count(*) FILTER (WHERE hash IN (SELECT hash FROM sh)) AS shared FROM lm GROUP BY ALL)
SELECT clip, CAST(stream AS BIGINT) AS stream, CAST(shared AS BIGINT) AS shared FROM h QUALIFY row_number() OVER (PARTITION BY clip ORDER BY shared DESC, stream) = 1"""
)
def stream_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C14: the stream of each recording that has most in common with others."""
    l = standins.doc_landmarks(spark, sf_dir).select(F.floor(F.col("clip") / 4).alias("clip"), (F.col("clip") % 4).alias("stream"), "hash")
    return matching.stream_choice(l)


# Time, names, mappings -------------------------------------------------------------------------------------------------

_RATES = "(VALUES (1001, 30000, true), (1001, 30000, false), (1, 25, false), (1001, 60000, true), (1, 24, true)) AS r(v, ts, df)"


def _rates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(1001, 30000, True), (1001, 30000, False), (1, 25, False), (1001, 60000, True), (1, 24, True)], "v bigint, ts bigint, df boolean")


@query(
    f"""WITH x AS (SELECT o_orderkey AS id, v, ts, df AND round(ts / v) IN (30, 60) AS drops, CAST(round(ts / v) AS BIGINT) AS n, o_orderkey * 9973 - 5000 AS fr FROM orders, {_RATES}),
y AS (SELECT *, CASE WHEN drops THEN n // 15 ELSE 0 END AS d FROM x),
z AS (SELECT *, 600 * n - 9 * d AS blk, CASE WHEN fr >= 0 THEN fr % (144 * (600 * n - 9 * d)) END AS e FROM y),
q AS (SELECT *, CASE WHEN d = 0 THEN fr ELSE (e // blk) * 600 * n + CASE WHEN e % blk < 60 * n THEN e % blk ELSE ((e % blk - 60 * n) // (60 * n - d) + 1) * 60 * n + (e % blk - 60 * n) % (60 * n - d) + d END END % (86400 * n) AS k FROM z)
SELECT id, v, ts, CASE WHEN fr >= 0 THEN printf('%02d:%02d:%02d%s%02d', k // n // 3600 % 24, k // n // 60 % 60, k // n % 60, CASE WHEN drops THEN ';' ELSE ':' END, k % n) END AS label, CASE WHEN fr >= 0 THEN fr % (CASE WHEN drops THEN 144 * blk ELSE 86400 * n END) END AS back FROM q WHERE drops OR v = 1"""
)
def timecode_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of frame numbers, and the frame numbers of those labels."""
    x = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") * 9973 - 5000).alias("fr")).join(F.broadcast(_rates(spark)))
    n = timecode.nominal_fps(F.col("v"), F.col("ts"))
    drops = F.col("df") & F.col("n").isin(30, 60)
    x = timecode.labelled(x.withColumn("n", n).where(drops | (F.col("v") == 1)), "fr", "n", "df")
    return timecode.counted(x, "label", "n", "back").select("id", "v", "ts", "label", "back")


@query(
    """SELECT p_partkey AS id, CAST(floor(p_partkey * 48000 * 25 / (CASE WHEN p_partkey % 2 = 0 THEN 48000 ELSE 44100 END * 1)) AS BIGINT) AS frames, CAST(round(p_retailprice * 1000000) AS BIGINT) AS micros,
abs(p_retailprice * ((p_size - 25) * 0.00001)) + 1e-9 >= 0.016 AS slips, CAST(greatest(1, ceil(p_retailprice * 25 - 1e-6)) AS BIGINT) AS covering FROM part"""
)
def time_arithmetic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples as frames, seconds as microseconds, drift worth correcting, frames that cover a length."""
    rate = F.when(F.col("p_partkey") % 2 == 0, 48000.0).otherwise(44100.0)
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), timecode.frames_of_samples(F.col("p_partkey") * 48000, rate, F.lit(1), F.lit(25)).alias("frames"), timecode.micros_of(F.col("p_retailprice")).alias("micros"),
        timecode.slips(F.col("p_retailprice"), 1 + (F.col("p_size") - 25) * F.lit(0.00001)).alias("slips"), timecode.frames_covering(F.col("p_retailprice"), F.lit(0.04)).alias("covering"),
    )


_STANDARD = ", ".join(f"({i}, {d}, {n})" for i, (n, d) in enumerate(timecode.STANDARD_RATES))


@query(
    f"""WITH f AS (SELECT p_partkey AS id, 20 + (p_partkey % 4500) / 100.0 AS fps FROM part), s(i, v, ts) AS (VALUES {_STANDARD}),
c AS (SELECT id, i, v, ts, abs(fps - ts / CAST(v AS DOUBLE)) / (ts / CAST(v AS DOUBLE)) AS d FROM f, s),
b AS (SELECT * FROM c WHERE d <= 0.001 QUALIFY row_number() OVER (PARTITION BY id ORDER BY d, i) = 1)
SELECT id, CAST(v AS BIGINT) AS value, CAST(ts AS BIGINT) AS timescale FROM f LEFT JOIN b USING (id)"""
)
def standard_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The standard frame duration of a nominal rate."""
    x = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), timecode.standard_frame(20 + (F.col("p_partkey") % 4500) / 100).alias("f"))
    return x.select("id", F.col("f.value").cast("bigint").alias("value"), F.col("f.timescale").cast("bigint").alias("timescale"))


@query(
    r"""SELECT page_id, regexp_extract(url, '([^/]*)$', 1) AS file, regexp_replace(url, '/[^/]*$', '') AS folder, substr(sha256(url || chr(0) || CAST(page_id * 1000 AS VARCHAR)), 1, 24) AS clip,
printf('imported-%s-%06d', 'audio', page_id) AS track, CASE WHEN page_id % 3 = 0 THEN url ELSE '* ' || url END AS label, replace(replace(replace(replace(replace(url, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS xml FROM pages"""
)
def path_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts, keys and marks of paths."""
    u = F.col("url")
    return table(spark, sf_dir, "pages").select(
        "page_id", names.file_name(u).alias("file"), names.folder(u).alias("folder"), names.clip_id(u, F.col("page_id") * 1000).alias("clip"), names.track_key(F.lit("audio"), F.col("page_id")).alias("track"),
        names.assigned(u, F.col("page_id") % 3 != 0, F.lit(None).cast("string"), F.lit(False)).alias("label"), names.xml_escaped(u).alias("xml"),
    )


@query(
    """WITH x AS (SELECT o_orderkey AS id, CAST(o_orderkey % 50 AS DOUBLE) AS x, CAST(10 + o_custkey % 5 AS DOUBLE) AS s1, CAST(12 + o_custkey % 7 AS DOUBLE) AS i1 FROM orders)
SELECT id, CASE WHEN x < s1 THEN x * i1 / s1 ELSE i1 + (x - s1) * (60 - i1) / (40 - s1) END AS y, x BETWEEN 0 AND 40 AS inside FROM x"""
)
def mapped_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times through a mapping of three knots."""
    def knot(a, b):
        return F.struct(a.cast("double").alias("source"), b.cast("double").alias("island"))

    k = F.array(knot(F.lit(0), F.lit(0)), knot(10 + F.col("o_custkey") % 5, 12 + F.col("o_custkey") % 7), knot(F.lit(40), F.lit(60)))
    x = (F.col("o_orderkey") % 50).cast("double")
    t = table(spark, sf_dir, "orders").withColumn("k", k)
    return t.select(F.col("o_orderkey").alias("id"), mapping.value_at(F.col("k"), x).alias("y"), mapping.contains(F.col("k"), x).alias("inside"))


@query(
    """WITH d AS (SELECT user_id, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s FROM events),
g AS (SELECT user_id, count(s) FILTER (WHERE s > 0) AS n, min(s) FILTER (WHERE s > 0) AS lo, max(s) FILTER (WHERE s > 0) AS hi FROM d GROUP BY user_id)
SELECT user_id, CASE WHEN n < 2 THEN 'unknown' WHEN hi - lo > greatest(1e-5, 0.005 * lo) THEN 'variable' ELSE 'constant' END AS mode FROM g"""
)
def frame_rate_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the times between a user's events vary."""
    ts = F.expr(EPOCH_MICROS) / 1e6
    d = table(spark, sf_dir, "events").withColumn("seconds", ts - F.lag(ts).over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    return signal.frame_rate_mode(d, ["user_id"])


# Intervals -------------------------------------------------------------------------------------------------------------

_INTERVALS = "iv AS (SELECT o_orderkey AS id, o_custkey AS source, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS s, greatest(CAST(o_orderdate AS DATE), max(CAST(l_shipdate AS DATE))) - DATE '1970-01-01' + 1 AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey, o_custkey, o_orderdate)"


@query("WITH " + _INTERVALS + " SELECT a.id AS a, b.id AS b, CAST(least(a.e, b.e) - greatest(a.s, b.s) AS BIGINT) AS days FROM iv a JOIN iv b ON a.source = b.source AND a.id < b.id AND a.s < b.e AND b.s < a.e")
def overlapping_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C11 and the interval join: orders of one customer that overlap in time."""
    iv = standins.order_intervals(spark, sf_dir)
    met = intervals.overlap_join(iv, iv, 60, ["source"]).where("l_id < r_id")
    return met.select(F.col("l_id").alias("a"), F.col("r_id").alias("b"), intervals.overlap(F.col("l_start"), F.col("l_end"), F.col("r_start"), F.col("r_end")).alias("days"))


@query(
    "WITH "
    + _INTERVALS
    + """, b AS (SELECT *, coalesce(max(e) OVER (PARTITION BY source ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM iv),
g AS (SELECT *, sum(greatest(0, s - before)) OVER (PARTITION BY source ORDER BY s, e, id) AS shift FROM b)
SELECT id, source, CAST(s - shift AS BIGINT) AS start, CAST(e - shift AS BIGINT) AS "end" FROM g"""
)
def closed_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A customer's orders without the time in which none was open."""
    return intervals.close_gaps(standins.order_intervals(spark, sf_dir), ["source"]).select("id", "source", "start", "end")


@query(
    "WITH "
    + _INTERVALS
    + """, b AS (SELECT source, s, coalesce(max(e) OVER (PARTITION BY source ORDER BY s, e, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM iv)
SELECT source, CAST(before AS BIGINT) AS start, CAST(s AS BIGINT) AS "end" FROM b WHERE s - before > 2"""
)
def explicit_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gaps between a customer's orders."""
    return intervals.with_gaps(standins.order_intervals(spark, sf_dir), ["source"], 2)


@query(
    "WITH "
    + _INTERVALS
    + """, k AS (SELECT *, CASE WHEN id % 3 = 0 THEN 'video' ELSE 'audio' END AS kind FROM iv)
SELECT id FROM k WHERE kind = 'video' OR source NOT IN (SELECT source FROM k WHERE kind = 'video') OR EXISTS (SELECT 1 FROM k v WHERE v.kind = 'video' AND v.source = k.source AND v.s < k.e AND k.s < v.e)"""
)
def lone_recorders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound that no picture of its island overlaps goes."""
    iv = standins.order_intervals(spark, sf_dir).select("id", F.col("source").alias("island"), F.when(F.col("id") % 3 == 0, "video").otherwise("audio").alias("kind"), "start", "end")
    return intervals.lone_recorders(iv, 60).select("id")


def _roles(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All orders: every third one a video, the others recorders."""
    iv = standins.order_intervals(spark, sf_dir)
    r = iv.where("id % 3 <> 0").withColumns({"position": F.col("id") * 31 % 1009, "lane": F.col("id") % 4, "source_in": F.lit(0), "confidence": F.lit(0.9)})
    return iv.where("id % 3 = 0").withColumn("confidence", F.lit(1.0)), r


_ROLES = ", v AS (SELECT * FROM iv WHERE id % 3 = 0), r AS (SELECT *, id * 31 % 1009 AS pos, id % 4 AS lane FROM iv WHERE id % 3 <> 0) "


@query(
    "WITH "
    + _INTERVALS
    + _ROLES
    + """SELECT v.id, r.id AS recorder, CAST(r.lane AS BIGINT) AS lane, CAST(greatest(v.s, r.s) AS BIGINT) AS start, CAST(least(v.e, r.e) AS BIGINT) AS "end" FROM v JOIN r ON v.source = r.source AND v.s < r.e AND r.s < v.e
QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY r.lane, least(v.e, r.e) - greatest(v.s, r.s) DESC, r.pos, r.id) = 1"""
)
def replaced_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recorder of its island (a customer's orders) that stands in for a camera's sound."""
    return intervals.replaced_audio(*_roles(spark, sf_dir), 60, ["source"]).select("id", "recorder", "lane", "start", "end")


@query("WITH " + _INTERVALS + _ROLES + "SELECT v.id, r.id AS recorder FROM v JOIN r ON v.source = r.source AND v.s < r.e AND r.s < v.e QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY r.pos, r.id) = 1")
def first_recorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first recorder of its island that overlaps a video."""
    return intervals.first_overlapping(*_roles(spark, sf_dir), 60, ["source"])


@query(
    """WITH o AS (SELECT o_orderkey AS id, o_custkey AS f, CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS DOUBLE) AS s FROM orders),
v AS (SELECT id, f, s, s + 10 AS e FROM o WHERE id % 2 = 0), a AS (SELECT id, f, s, s + 10 + id % 3 AS e, CASE WHEN id % 10 = 1 THEN id + 1 END AS link FROM o WHERE id % 2 = 1),
n AS (SELECT v.id AS video, min(a.id) AS audio, count(*) AS c FROM a JOIN v ON a.link = v.id GROUP BY ALL),
x AS (SELECT v.id AS video, a.id AS near FROM v JOIN a ON v.f = a.f AND abs(a.s - v.s) <= 20 AND abs(a.e - v.e) <= 20 QUALIFY row_number() OVER (PARTITION BY v.id ORDER BY abs(a.s - v.s) + abs(a.e - v.e), a.id) = 1)
SELECT v.id AS video, CASE WHEN c = 1 THEN audio WHEN c IS NULL THEN near END AS audio FROM v LEFT JOIN n ON n.video = v.id LEFT JOIN x ON x.video = v.id"""
)
def nearest_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sound that belongs to a picture: named, or nearest within a tolerance."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file"), F.unix_date(F.to_date("o_orderdate")).cast("double").alias("start"))
    v = o.where("id % 2 = 0").withColumn("end", F.col("start") + 10)
    a = o.where("id % 2 = 1").withColumns({"end": F.col("start") + 10 + F.col("id") % 3, "linked": F.when(F.col("id") % 10 == 1, F.col("id") + 1)})
    return intervals.nearest_audio(v, a, F.lit(10.0))


@query(
    """WITH i AS (SELECT l_orderkey AS o, l_linenumber AS n, CAST(l_quantity AS DOUBLE) AS d, l_extendedprice AS st, l_discount > 0.05 AS rev FROM lineitem)
SELECT o, n, st + 2 AS start, d - 5 AS duration, CASE WHEN rev THEN 3.0 ELSE 2.0 END AS source_in, d - CASE WHEN rev THEN 2 ELSE 3 END AS source_out FROM i WHERE d - 5 > 0"""
)
def trimmed_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K5: items cut at both ends."""
    i = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("duration"), F.col("l_extendedprice").alias("start"), F.lit(0.0).alias("source_in"), F.col("l_quantity").alias("source_out"), F.lit(1.0).alias("rate"), (F.col("l_discount") > 0.05).alias("reverse"))
    return intervals.trimmed(i, F.lit(2.0), F.lit(3.0)).select("o", "n", "start", "duration", "source_in", "source_out")


@query(
    """WITH d AS (SELECT DISTINCT user_id, CAST(ts AS DATE) - DATE '2024-01-01' AS n FROM events), r AS (SELECT user_id, n, n - row_number() OVER (PARTITION BY user_id ORDER BY n) AS run FROM d),
g AS (SELECT user_id, run, count(*) AS length, min(n) AS f FROM r GROUP BY ALL HAVING count(*) >= 3)
SELECT user_id, CAST(f AS BIGINT) AS first, length FROM g QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY f) = 1"""
)
def consecutive_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first run of days in a row on which a user was seen."""
    n = F.datediff(F.to_date("ts"), F.lit("2024-01-01").cast("date")).cast("bigint")
    d = table(spark, sf_dir, "events").select("user_id", n.alias("number")).distinct().withColumn("at", F.col("number"))
    return intervals.consecutive_runs(d, ["user_id"], 3)


@query("""SELECT c_custkey AS position, CAST(c_custkey % 7 AS DOUBLE) AS length, coalesce(sum(CAST(c_custkey % 7 + 1 AS DOUBLE)) OVER (ORDER BY c_custkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), CAST(0 AS DOUBLE)) AS start FROM customer""")
def packed_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups one behind another with a second between them."""
    return intervals.packed(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("position"), (F.col("c_custkey") % 7).cast("double").alias("length")))


@query("WITH " + _INTERVALS + """ SELECT id, s * 2.0 AS x, least(e - s, coalesce(lead(s) OVER (PARTITION BY source ORDER BY s, id) - s, 1e18)) * 2.0 AS width FROM iv""")
def bar_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars that end where the next begins."""
    return intervals.bar_geometry(standins.order_intervals(spark, sf_dir), 2.0, ["source"]).select("id", "x", "width")


@query(
    """WITH RECURSIVE c AS (SELECT c_custkey AS id, CAST(c_custkey * 7919 % 3600 AS DOUBLE) AS s, abs(c_acctbal) % 120 AS d, c_custkey % 10 = 0 AS placed FROM customer WHERE abs(c_acctbal) % 120 > 0),
met AS (SELECT l.id AS lid, r.id AS rid, l.s AS ls, r.s AS rs, l.d AS ld, r.d AS rd, r.placed AS anchored, least(l.s + l.d, r.s + r.d) - greatest(l.s, r.s) AS shared FROM c l JOIN c r ON NOT l.placed AND l.id <> r.id AND l.s < r.s + r.d AND r.s < l.s + l.d),
k AS (SELECT *, row_number() OVER (PARTITION BY lid ORDER BY anchored DESC, shared DESC, rid) AS rank FROM met),
free AS (SELECT lid, row_number() OVER (ORDER BY lid) AS n, list(rid ORDER BY rank) AS others FROM k WHERE lid NOT IN (SELECT lid FROM k WHERE anchored) GROUP BY lid),
f AS (SELECT CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT) AS lid, CAST(NULL AS BIGINT) AS rid, CAST([] AS VARCHAR[]) AS used UNION ALL
SELECT n, lid, x, CASE WHEN x IS NULL THEN used ELSE list_append(used, least(lid, x) || ':' || greatest(lid, x)) END
FROM (SELECT free.n, CAST(free.lid AS BIGINT) AS lid, used, CAST(list_filter(others, lambda o: NOT list_contains(used, least(free.lid, o) || ':' || greatest(free.lid, o)))[1] AS BIGINT) AS x FROM f JOIN free ON free.n = f.n + 1)),
chosen AS (SELECT lid, rid FROM f WHERE rid IS NOT NULL UNION ALL SELECT lid, rid FROM k WHERE rank = 1 AND anchored),
e AS (SELECT CASE WHEN swap THEN rid ELSE lid END AS "left", CASE WHEN swap THEN lid ELSE rid END AS "right", CASE WHEN swap THEN rs ELSE ls END AS lt, CASE WHEN swap THEN ls ELSE rs END AS rt, CASE WHEN swap THEN rd ELSE ld END AS ld, CASE WHEN swap THEN ld ELSE rd END AS rd, shared FROM (SELECT k.*, anchored OR rid < lid AS swap FROM k JOIN chosen USING (lid, rid)))
SELECT "left", "right", CAST(1 AS DOUBLE) AS rate, lt - rt AS "offset", CAST({confidence} AS DOUBLE) AS confidence, CAST(1 AS BIGINT) AS anchors, greatest(CAST(0 AS DOUBLE), rt - lt) AS left_start, least(ld, rt + rd - lt) AS left_end, shared AS covered, CAST(0 AS DOUBLE) AS residual, 'timecode' AS evidence FROM e""".replace("{confidence}", str(S.TIMECODE_CONFIDENCE))
)
def timecode_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips placed by timecode alone."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("position"), (F.col("c_custkey") * 7919 % 3600).cast("double").alias("tc"), (F.abs("c_acctbal") % 120).alias("duration"), F.lit(None).cast("double").alias("recorded"))
    return intervals.timecode_edges(c, c.where("id % 10 = 0").select("id"), width=120.0).drop("points")


@query(
    "WITH RECURSIVE "
    + _INTERVALS
    + """, c AS (SELECT CAST(id AS VARCHAR) AS id, source % 50 AS project, CAST(source AS VARCHAR) AS key, CAST(s AS DOUBLE) AS s, CAST(e - s AS DOUBLE) AS d FROM iv),
o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY s, d DESC, id) AS n FROM c),
w AS (SELECT key, n, id, 1 AS lane, [{'e': s + d, 'd': d}] AS ends FROM o WHERE n = 1 UNION ALL
SELECT key, n, id, lane, CASE WHEN lane > len(ends) THEN list_append(ends, {'e': s + d, 'd': d}) ELSE list_transform(range(1, len(ends) + 1), lambda i: CASE WHEN i = lane AND s + d >= ends[i].e THEN {'e': s + d, 'd': d} ELSE ends[i] END) END
FROM (SELECT o.key, o.n, o.id, o.s, o.d, ends, CAST(coalesce(list_filter(range(1, len(ends) + 1), lambda i: ends[i].e <= o.s + greatest(1e-6, least(0.5, o.d / 2, ends[i].d / 2)))[1], len(ends) + 1) AS INTEGER) AS lane FROM w JOIN o ON o.key = w.key AND o.n = w.n + 1)),
own AS (SELECT project, c.key, lane, id, s, s + d AS e FROM c JOIN w USING (id)),
l AS (SELECT project, key, lane, row_number() OVER (PARTITION BY project ORDER BY first, key, lane) AS n FROM (SELECT project, key, lane, min(s) AS first FROM own GROUP BY ALL)),
x AS (SELECT own.project, l.n, s, e FROM own JOIN l USING (key, lane)),
nr AS (SELECT b.project, b.n, list(DISTINCT a.n) AS near FROM x a JOIN x b ON a.project = b.project AND a.n < b.n AND a.s < b.e AND b.s < a.e GROUP BY ALL),
m AS (SELECT l.project, l.n, coalesce(near, []) AS near FROM l LEFT JOIN nr USING (project, n)),
t AS (SELECT project, n, 0 AS track, [0] AS tracks FROM m WHERE n = 1 UNION ALL
SELECT project, n, track, list_append(tracks, track) FROM (SELECT project, n, tracks, CAST(list_filter(range(0, len(used) + 1), lambda v: NOT list_contains(used, v))[1] AS INTEGER) AS track FROM (SELECT m.project, m.n, tracks, list_transform(near, lambda z: tracks[z]) AS used FROM t JOIN m ON m.project = t.project AND m.n = t.n + 1)))
SELECT id, track FROM own JOIN l USING (key, lane) JOIN t ON t.project = l.project AND t.n = l.n"""
)
def allocated_lanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals on lanes of their source, and these on tracks."""
    iv = standins.order_intervals(spark, sf_dir)
    r = iv.select(F.col("id").cast("string").alias("id"), F.col("source").cast("string").alias("source_key"), F.col("start").cast("double").alias("start"), (F.col("end") - F.col("start")).cast("double").alias("duration"), (F.col("source") % 50).alias("project"))
    return lanes.allocated(r, "project").select("id", "track")


# Files in parts, order, tracks -----------------------------------------------------------------------------------------

_PARTS = "p AS (SELECT l_orderkey AS set_id, l_linenumber AS part, l_suppkey % 2 AS layout, count(*) OVER (PARTITION BY l_orderkey) AS part_count, l_partkey AS clip, CAST(l_quantity AS DOUBLE) AS duration FROM lineitem), one AS (SELECT * FROM p QUALIFY count(*) OVER (PARTITION BY set_id, part) = 1)"


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem")
    return l.select(F.col("l_orderkey").alias("set_id"), F.col("l_linenumber").alias("part"), (F.col("l_suppkey") % 2).alias("layout"), F.count(F.lit(1)).over(Window.partitionBy("l_orderkey")).alias("part_count"), F.col("l_partkey").alias("clip"), F.col("l_quantity").alias("duration"), F.lit("audio").alias("kind"))


@query("WITH " + _PARTS + """ SELECT a.clip AS "left", b.clip AS "right", -a.duration AS "offset", a.duration AS covered FROM one a JOIN one b ON a.set_id = b.set_id AND a.part + 1 = b.part AND a.layout = b.layout""")
def span_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of one recording joined end to end."""
    return spans.span_edges(_parts(spark, sf_dir)).select("left", "right", "offset", "covered")


@query(
    "WITH "
    + _PARTS
    + """, s AS (SELECT set_id, max(part_count) AS expected, list_sort(list(DISTINCT part)) AS present FROM p GROUP BY set_id),
dup AS (SELECT set_id, list_sort(list(part)) AS d FROM (SELECT set_id, part FROM p GROUP BY ALL HAVING count(*) > 1) GROUP BY set_id),
ok AS (SELECT a.set_id, list(a.part) AS g FROM one a JOIN one b ON a.set_id = b.set_id AND a.part + 1 = b.part AND a.layout = b.layout GROUP BY 1),
x AS (SELECT set_id, list_filter(generate_series(1, expected), lambda n: NOT list_contains(present, CAST(n AS INTEGER))) AS missing, coalesce(d, []) AS duplicate, list_filter(present, lambda n: list_contains(present, n + 1) AND NOT list_contains(coalesce(g, []), n)) AS incompatible FROM s LEFT JOIN dup USING (set_id) LEFT JOIN ok USING (set_id))
SELECT set_id, array_to_string(missing, ',') AS missing, array_to_string(duplicate, ',') AS duplicate, array_to_string(incompatible, ',') AS incompatible FROM x WHERE len(missing) + len(duplicate) + len(incompatible) > 0"""
)
def span_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is missing, double or doesn't fit in sets of parts."""
    d = spans.diagnostics(_parts(spark, sf_dir))
    return d.select("set_id", *(F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("missing", "duplicate", "incompatible")))


def _context(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip"), F.lit("audio").alias("kind"), F.col("c_nationkey").cast("string").alias("source"), F.col("c_custkey").alias("position"), F.when(F.col("c_custkey") % 5 > 0, F.floor("c_acctbal")).alias("recorded"), F.col("c_name").alias("name"))
    return order.order_context(c)


_CONTEXT = "cx AS (SELECT c_custkey AS clip, 'audio:' || c_nationkey AS track, CAST(c_custkey AS BIGINT) AS as_imported, row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 5 > 0 THEN floor(c_acctbal) END NULLS LAST, c_custkey) - 1 AS by_date, row_number() OVER (PARTITION BY c_nationkey ORDER BY lower(c_name), c_custkey) - 1 AS by_name FROM customer)"


@query("WITH " + _CONTEXT + " SELECT * FROM cx")
def order_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of clips on their tracks."""
    return _context(spark, sf_dir).drop("imported")


def _track_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("left"), (F.col("o_orderkey") % 1400 + 1).alias("right"), (F.floor(F.col("o_totalprice")) / 1000).alias("confidence"), F.col("o_orderkey").alias("position"), F.lit("waveform").alias("evidence"))


_TRACK_EDGES = "te AS (SELECT o_custkey AS l, o_orderkey % 1400 + 1 AS r, o_orderkey AS position FROM orders)"


@query(
    "WITH "
    + _CONTEXT
    + ", "
    + _TRACK_EDGES
    + """ SELECT position, CASE WHEN a.track <> b.track THEN least(a.track, b.track) END AS low_track, CASE WHEN a.track <> b.track THEN greatest(a.track, b.track) END AS high_track,
CASE WHEN a.track < b.track THEN a.by_date WHEN a.track > b.track THEN b.by_date END AS low_rank, CASE WHEN a.track < b.track THEN b.by_date WHEN a.track > b.track THEN a.by_date END AS high_rank FROM te LEFT JOIN cx a ON a.clip = l LEFT JOIN cx b ON b.clip = r"""
)
def ordered_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """C20: edges with the ranks of both ends on their tracks."""
    return order.ordered_edges(_track_edges(spark, sf_dir), _context(spark, sf_dir), None, "date").select("position", "low_track", "high_track", "low_rank", "high_rank")


@query(
    "WITH RECURSIVE "
    + _CONTEXT
    + """, te AS (SELECT o_custkey AS l, o_orderkey % 1400 + 1 AS r, floor(o_totalprice) / 1000 AS confidence, o_orderkey AS position FROM orders),
oe AS (SELECT position, confidence, a.track < b.track AS low, least(a.track, b.track) AS lt, greatest(a.track, b.track) AS ht, CASE WHEN low THEN a.by_date ELSE b.by_date END AS lr, CASE WHEN low THEN b.by_date ELSE a.by_date END AS hr, coalesce(a.track <> b.track, false) AS says FROM te LEFT JOIN cx a ON a.clip = l LEFT JOIN cx b ON b.clip = r),
q AS (SELECT position, lt, ht, lr, hr, row_number() OVER (PARTITION BY lt, ht ORDER BY confidence DESC, position) AS n FROM oe WHERE says),
f AS (SELECT lt, ht, n, position, true AS fits, [{'l': lr, 'h': hr}] AS kept FROM q WHERE n = 1 UNION ALL
SELECT lt, ht, n, position, fits, CASE WHEN fits THEN list_append(kept, {'l': lr, 'h': hr}) ELSE kept END
FROM (SELECT q.*, kept, len(list_filter(kept, lambda k: (k.l < q.lr AND k.h > q.hr) OR (k.l > q.lr AND k.h < q.hr))) = 0 AS fits FROM f JOIN q ON q.lt = f.lt AND q.ht = f.ht AND q.n = f.n + 1))
SELECT position FROM f WHERE fits UNION ALL SELECT position FROM oe WHERE NOT says"""
)
def uncrossed_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The strongest edges that keep the order."""
    return order.enforce_clip_order(_track_edges(spark, sf_dir), _context(spark, sf_dir), None, "date").select("position")


@query("WITH " + _CONTEXT + ", " + _TRACK_EDGES + ", m AS (SELECT clip, track, CASE clip % 3 WHEN 0 THEN 'linear' WHEN 1 THEN 'takes' ELSE 'auto' END AS mode FROM cx) SELECT position FROM te LEFT JOIN m a ON a.clip = l LEFT JOIN m b ON b.clip = r WHERE a.track IS DISTINCT FROM b.track OR a.track IS NULL OR NOT (a.mode = 'linear' OR b.mode = 'linear')")
def track_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges inside one track, by what the track holds."""
    c = _context(spark, sf_dir)
    modes = c.select("clip", F.when(F.col("clip") % 3 == 0, "linear").when(F.col("clip") % 3 == 1, "takes").otherwise("auto").alias("mode"))
    return order.enforce_track_content(_track_edges(spark, sf_dir), c, modes).select("position")


# Aggregates ------------------------------------------------------------------------------------------------------------


@query(
    """WITH s AS (SELECT l_partkey, list_sort(list(l_extendedprice)) AS v, quantile_cont(l_extendedprice, 0.5) AS median, regr_slope(l_extendedprice, l_quantity) AS slope FROM lineitem GROUP BY 1)
SELECT l_partkey, v[len(v) // 2 + 1] AS upper, round(median, 4) AS median, round(slope, 3) AS slope FROM s"""
)
def medians_and_slopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three medians' two kinds, and least squares."""
    g = table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(assembly.upper_median("l_extendedprice").alias("upper"), F.percentile("l_extendedprice", 0.5).alias("median"), assembly.line_fit("l_quantity", "l_extendedprice").alias("f"))
    return g.select("l_partkey", "upper", F.round("median", 4).alias("median"), F.round("f.slope", 3).alias("slope"))


@query("SELECT user_id, CASE WHEN count(value) = 1 OR max(value) - min(value) <= 2 THEN round(quantile_cont(value, 0.5), 6) END AS median FROM events GROUP BY user_id, event_type, CAST(ts AS DATE)")
def consistent_medians(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Medians of values that agree."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type", F.to_date("ts").alias("d")).agg(F.round(assembly.consistent_median("value"), 6).alias("median")).select("user_id", "median")


_EDGES = """ed AS (SELECT l_partkey AS l, l_suppkey + 10000000 AS r, max(l_quantity) / 50 AS confidence, count(*) AS anchors, max(l_quantity) AS covered, max(l_tax) AS residual,
CASE WHEN l_partkey % 7 = 0 THEN 'span' WHEN l_partkey % 5 = 0 THEN 'timecode' ELSE 'waveform' END AS evidence FROM lineitem GROUP BY ALL),
ad AS (SELECT * FROM ed WHERE evidence = 'span' OR (confidence >= 0.55 AND (evidence = 'timecode' OR anchors >= 3) AND covered >= 3 AND residual <= 0.1))"""


@query("WITH " + _EDGES + ' SELECT l AS "left", r AS "right" FROM ad')
def admitted_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """edges that count."""
    return graph.admitted(standins.line_edges(spark, sf_dir)).select("left", "right")


@query("WITH " + _EDGES + ' SELECT l AS "left", r AS "right", row_number() OVER (ORDER BY floor(confidence * 10000 + 0.5) DESC, anchors DESC, floor(covered * 10 + 0.5) DESC, floor(residual * 10000 + 0.5), l, r) AS n FROM ad')
def edge_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All edges that count, in their total order."""
    return graph.ranked(graph.admitted(standins.line_edges(spark, sf_dir))).select("left", "right", "n")


@query(
    "WITH "
    + _EDGES
    + ", e AS (SELECT l AS clip, confidence FROM ad UNION ALL SELECT r, confidence FROM ad) SELECT clip, round(sum(confidence), 6) AS degree, max(confidence) AS confidence FROM e GROUP BY clip"
)
def degrees(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed and greatest confidence of each clip."""
    return graph.degrees(graph.admitted(standins.line_edges(spark, sf_dir))).withColumn("degree", F.round("degree", 6))


@query("WITH " + _EDGES + ' SELECT l AS "left", r AS "right", round(confidence * confidence * least(16, greatest(0.1, anchors / 100.0)) / power(0.004 + 2 * residual, 2), 6) AS weight FROM ad')
def base_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """weights of edges."""
    e = graph.admitted(standins.line_edges(spark, sf_dir))
    return e.select("left", "right", F.round(graph.base_weight(F.col("confidence"), F.col("anchors"), F.col("residual")), 6).alias("weight"))


_REACH = """, e2 AS (SELECT "left" AS a, "right" AS b FROM clear UNION SELECT "right", "left" FROM clear),
reach AS (SELECT a, a AS b FROM e2 UNION SELECT reach.a, e2.b FROM reach JOIN e2 ON reach.b = e2.a)"""


@query(_PLAIN.replace("WITH ", "WITH RECURSIVE ", 1) + _REACH + " SELECT a AS clip, min(b) AS root FROM reach GROUP BY a")
def document_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """components of documents that match."""
    e = matching.best_offsets(standins.doc_landmarks(spark, sf_dir), standins.doc_count(spark, sf_dir))
    return graph.components(e.select(F.col("left").alias("a"), F.col("right").alias("b"))).select(F.col("node").alias("clip"), "root")


@query()
def solved_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placements of matched documents. (Least squares: held against known chains in the tests.)"""
    e = matching.matched(standins.doc_landmarks(spark, sf_dir), standins.doc_count(spark, sf_dir))
    clips = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("clip"))
    return graph.stage(clips, e).drop("points")


_CHAINS = """o AS (SELECT o_orderkey AS k, o_custkey AS c, CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS t, CAST(CASE o_orderkey % 3 WHEN 0 THEN 0.5 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS r, row_number() OVER (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey) AS n, count(*) OVER (PARTITION BY o_custkey) AS m FROM orders)"""


def _chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as clips, each with the next and the next but one: customer, left, right, days between them and the rates of their clocks."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_custkey").alias("c"), F.unix_date(F.to_date("o_orderdate")).alias("t"), F.when(F.col("o_orderkey") % 3 == 0, 0.5).when(F.col("o_orderkey") % 3 == 1, 1.0).otherwise(2.0).alias("r"))
    own = F.struct("k", "t", "r")
    one, two = (F.lead(own, d).over(Window.partitionBy("c").orderBy("t", "k")) for d in (1, 2))
    pairs = o.select("c", own.alias("a"), one.alias("one"), two.alias("two")).select("c", "a", F.posexplode(F.array("one", "two")).alias("step", "b")).where("b IS NOT NULL")
    return pairs.select(F.col("c").alias("customer"), F.col("a.k").alias("left"), F.col("b.k").alias("right"), (F.col("a.t") - F.col("b.t")).cast("double").alias("days"), F.col("a.r").alias("l_rate"), F.col("b.r").alias("r_rate"), "step")


@query(
    "WITH "
    + _CHAINS
    + """, d AS (SELECT *, CAST(n > 1 AS INTEGER) + CAST(n > 2 AS INTEGER) + CAST(n < m AS INTEGER) + CAST(n < m - 1 AS INTEGER) AS degree FROM o),
x AS (SELECT k, m, r / first_value(r) OVER (PARTITION BY c ORDER BY degree DESC, k) AS rate, (t - min(t) OVER (PARTITION BY c)) / first_value(r) OVER (PARTITION BY c ORDER BY degree DESC, k) AS "offset", min(k) OVER (PARTITION BY c) AS least FROM d),
i AS (SELECT least, row_number() OVER (ORDER BY least) - 1 AS island FROM (SELECT DISTINCT least FROM x WHERE m > 1))
SELECT k AS clip, CASE WHEN m > 1 THEN island END AS island, CASE WHEN m > 1 THEN round(rate, 6) END AS rate, CASE WHEN m > 1 THEN round("offset", 3) END AS "offset", CASE WHEN m > 1 THEN CAST(0.75 AS DOUBLE) END AS confidence, CASE WHEN m > 1 THEN floor((rate - 1) * 1e9 + 0.5) / 1e3 END AS drift_ppm FROM x LEFT JOIN i USING (least)"""
)
def chained_placements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Islands of each customer's orders on clocks of three rates, solved from pairs of neighbours; pairs agree with each
    other, so what was put in has to come out."""
    e = _chains(spark, sf_dir).select(
        "left", "right", (F.col("l_rate") / F.col("r_rate")).alias("rate"), (F.col("days") / F.col("r_rate")).alias("offset"), F.lit(0.75).alias("confidence"), (F.col("left") % 50 + 3).cast("bigint").alias("anchors"),
        F.lit(10.0).alias("covered"), F.lit(0.01).alias("residual"), F.lit("waveform").alias("evidence"),
    )
    done = graph.stage(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("clip")), e)
    return done.select("clip", "island", F.round("rate", 6).alias("rate"), F.round("offset", 3).alias("offset"), "confidence", "drift_ppm")


@query(
    "WITH RECURSIVE "
    + _CHAINS
    + """, e AS (SELECT a.c, a.m, a.k AS l, b.k AS r, a.n AS a, b.n AS b, (a.k * 7 + b.k * 13) % 100 / 100 AS confidence, row_number() OVER (PARTITION BY a.c ORDER BY a.k, b.n - a.n) AS n FROM o a JOIN o b ON a.c = b.c AND b.n - a.n IN (1, 2)),
f AS (SELECT c, CAST(0 AS BIGINT) AS n, l, r, false AS stays, range(1, m + 1) AS tree FROM e WHERE n = 1 UNION ALL
SELECT e.c, e.n, e.l, e.r, tree[a] <> tree[b] OR confidence >= 0.85, list_transform(tree, lambda x: CASE WHEN x = tree[a] THEN tree[b] ELSE x END) FROM f JOIN e ON e.c = f.c AND e.n = f.n + 1)
SELECT l AS "left", r AS "right" FROM f WHERE stays"""
)
def gated_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of pairs of a customer's orders, in turn, those that join two trees or are sure."""
    c = _chains(spark, sf_dir).select("customer", "left", "right", ((F.col("left") * 7 + F.col("right") * 13) % 100 / 100).alias("confidence"), (F.col("left") * 2 + F.col("step")).alias("position"))
    return graph.gated(c, key="customer").select("left", "right")


# Signals and landmarks -------------------------------------------------------------------------------------------------


def _event_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("clip"), F.floor(F.expr(EPOCH_MICROS) / 3.6e9).cast("bigint").alias("frame"), F.floor("value").cast("bigint").alias("bin")).distinct()


@query(
    """WITH p AS (SELECT DISTINCT user_id AS clip, epoch_us(ts) // 3600000000 AS frame, CAST(floor(value) AS BIGINT) AS bin FROM events)
SELECT a.clip, (a.bin << 32) | (t.bin << 16) | d AS hash, a.frame FROM p a, (VALUES (8), (20), (36)) AS x(d), p t WHERE t.clip = a.clip AND t.frame = a.frame + d"""
)
def landmark_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Landmarks of peaks."""
    return signal.landmarks(_event_peaks(spark, sf_dir))


@query(
    """WITH s AS (SELECT vec_id AS clip, unnest(embedding) AS x, unnest(generate_series(0, len(embedding) - 1)) AS pos FROM embeddings), r AS (SELECT clip, pos * 8 // 64 AS bin, sqrt(avg(CAST(x AS DOUBLE) * CAST(x AS DOUBLE))) AS rms FROM s GROUP BY ALL)
SELECT clip, CAST(bin AS BIGINT) AS bin, round(sqrt(rms / max(rms) OVER (PARTITION BY clip)), 6) AS level FROM r"""
)
def waveform_envelope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How loud parts of a recording are."""
    s = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("clip"), F.posexplode("embedding").alias("at", "x")).withColumn("x", F.col("x").cast("double"))
    return signal.envelope(s, 8).select("clip", F.col("bin").cast("bigint").alias("bin"), F.round("level", 6).alias("level"))


@query("WITH s AS (SELECT label AS clip, unnest(embedding) AS x, unnest(generate_series(0, len(embedding) - 1)) AS frame FROM embeddings) SELECT CAST(clip AS BIGINT) AS clip, CAST(frame AS BIGINT) AS frame, round(sum(CAST(x AS DOUBLE)) / 4, 5) AS x FROM s GROUP BY ALL")
def mixed_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streams mixed into one."""
    s = table(spark, sf_dir, "embeddings").select(F.col("label").cast("bigint").alias("clip"), F.posexplode("embedding").alias("frame", "x")).withColumn("x", F.col("x").cast("double"))
    return signal.mixed_streams(s, 4).select("clip", F.col("frame").cast("bigint").alias("frame"), F.round("x", 5).alias("x"))


@query()
def synchronised_takes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """K1: from sound to placements: the takes of tapes whose samples are the bytes of documents. (Landmarks and fits are numpy: tests hold
    placements against made-up truth.)"""
    from tidemark.plans.pipeline import synchronised

    return synchronised(standins.tapes(spark, sf_dir), size=standins.TAPE_BLOCK)


# Media, edits, stages --------------------------------------------------------------------------------------------------


@query("SELECT c_nationkey AS id, c_custkey AS clip, min(c_custkey) OVER (PARTITION BY c_nationkey) AS position FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey % 4 = 0 DESC, c_custkey) = 1")
def preferred_clips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One representation each."""
    c = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("id"), F.col("c_custkey").alias("clip"), F.col("c_custkey").alias("position"), (F.col("c_custkey") % 4 == 0).alias("has_video"))
    return library.preferred(c).select("id", "clip", "position")


@query("SELECT c_nationkey AS track, c_custkey AS clip FROM customer QUALIFY row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) = 1")
def first_warnings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H4: the first row with each key."""
    return library.first_of(table(spark, sf_dir, "customer"), "c_nationkey", F.struct("c_acctbal", "c_custkey")).select(F.col("c_nationkey").alias("track"), F.col("c_custkey").alias("clip"))


@query(
    r"""WITH p AS (SELECT page_id AS clip, regexp_replace(url, '/[^/]*$', '') AS root, CASE WHEN page_id % 3 = 0 THEN 'cam' || page_id % 2 END AS device, CASE WHEN page_id % 5 = 0 THEN 'audio' ELSE 'video' END AS kind FROM pages),
c AS (SELECT root, count(DISTINCT coalesce(device, '')) AS d, count(DISTINCT kind) AS k FROM p GROUP BY root) SELECT clip, root, CASE WHEN d > 1 THEN coalesce(device, kind) WHEN k > 1 THEN kind END AS part FROM p JOIN c USING (root)"""
)
def media_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clips by folder, device and kind."""
    p = table(spark, sf_dir, "pages").select(F.col("page_id").alias("clip"), F.col("url").alias("path"), F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("cam"), (F.col("page_id") % 2).cast("string"))).alias("device"), F.when(F.col("page_id") % 5 == 0, "audio").otherwise("video").alias("kind"))
    return library.bins(p)


@query("SELECT DISTINCT url AS path FROM pages WHERE page_id % 3 <> 0 AND url NOT IN (SELECT url FROM pages WHERE page_id % 3 = 0) AND NOT regexp_matches(lower(url), '[^./]\\.html$')")
def unresolved_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of edits that no clip has, but for an extension; every third page is a clip, the others are edits."""
    p = table(spark, sf_dir, "pages").select("page_id", F.col("url").alias("path"))
    return library.unresolved(p.where("page_id % 3 <> 0"), p.where("page_id % 3 = 0"), ("html",))


@query(
    """WITH e AS (SELECT o_orderkey AS edit, o_custkey AS k, o_orderkey % 2 = 0 AS vid, o_orderkey % 20 AS st, CASE WHEN o_orderkey % 4 = 1 THEN o_orderkey % 3 END AS channel FROM orders), c AS (SELECT c_custkey AS clip, c_nationkey % 2 = 0 AS vid, c_nationkey % 3 AS streams FROM customer),
m AS (SELECT edit, clip, e.vid, st, channel FROM e JOIN c ON c.clip = e.k WHERE CASE WHEN e.vid THEN c.vid ELSE streams > 0 END)
SELECT edit, clip FROM m QUALIFY vid OR row_number() OVER (PARTITION BY vid, clip, st, channel ORDER BY edit) = 1"""
)
def resolved_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edits with their clips, sound once."""
    k = F.col("o_orderkey")
    e = table(spark, sf_dir, "orders").select(k.alias("edit"), F.col("o_custkey").cast("string").alias("path"), F.when(k % 2 == 0, "video").otherwise("audio").alias("media"), (k % 20).alias("start"), (k % 20 + 1).alias("end"), (k % 20).alias("source_in"), (k % 20).alias("source_out"), F.when(k % 4 == 1, k % 3).alias("channel"), F.lit(0).alias("track_index"))
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip"), F.col("c_custkey").cast("string").alias("path"), F.when(F.col("c_nationkey") % 2 == 0, "video").otherwise("audio").alias("kind"), (F.col("c_nationkey") % 3).alias("audio_streams"))
    return library.resolved(e, c).select("edit", "clip")


@query(
    """WITH e AS (SELECT o_custkey AS clip, o_orderkey % 6 AS t, CAST(o_custkey * 10 + o_orderkey % 9 - o_orderkey % 100 AS DOUBLE) AS d FROM orders), m AS (SELECT printf('imported-audio-%06d', t) AS track, quantile_cont(d, 0.5) AS median FROM e GROUP BY t),
a AS (SELECT quantile_cont(median, 0.5) AS anchor FROM m WHERE track IN ('imported-audio-000001', 'imported-audio-000002')) SELECT track, CASE WHEN track IN ('imported-audio-000001', 'imported-audio-000002') THEN 0.0::DOUBLE ELSE round(median - anchor, 6) END AS shift FROM m, a"""
)
def track_shifts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far imported tracks move."""
    k = F.col("o_orderkey")
    e = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("clip"), F.lit("audio").alias("media"), (k % 6).alias("track_index"), (k % 9).cast("double").alias("source_in"), (k % 100).cast("double").alias("timeline_start"))

    def knot(a, b):
        return F.struct(a.cast("double").alias("source"), b.cast("double").alias("island"))

    p = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip"), F.array(knot(F.lit(0), F.col("c_custkey") * 10), knot(F.lit(1), F.col("c_custkey") * 10 + 1)).alias("points"))
    return assembly.track_shifts(e, p, ("imported-audio-000001", "imported-audio-000002")).withColumn("shift", F.round("shift", 6))


@query(
    """WITH t AS (SELECT c_custkey AS clip, c_nationkey % 4 AS track FROM customer UNION SELECT c_custkey, c_custkey % 4 FROM customer), l AS (SELECT clip, max(track * 2) AS deep FROM t WHERE track < 3 GROUP BY clip)
SELECT c_custkey AS clip, CAST(CASE WHEN c_custkey % 10 = 0 THEN 9 ELSE deep END AS BIGINT) AS level FROM customer LEFT JOIN l ON clip = c_custkey"""
)
def search_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How deep to search each clip."""
    c = table(spark, sf_dir, "customer")
    t = c.select(F.col("c_custkey").alias("clip"), (F.col("c_nationkey") % 4).cast("bigint").alias("track")).union(c.select("c_custkey", F.col("c_custkey") % 4)).distinct()
    levels = spark.createDataFrame([(0, 0), (1, 2), (2, 4)], "track bigint, level bigint")
    return library.search_levels(c.where("c_custkey % 10 = 0").select(F.col("c_custkey").alias("clip"), F.lit(9).cast("bigint").alias("level")), t, levels)


@query("SELECT CAST(2 AS BIGINT) AS stage, (SELECT count(*) FROM customer WHERE c_custkey % 3 > 0) AS placed")
def best_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of four stages, of which the last repeats the one before it, the one that places most."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip"))
    n = F.col("clip")
    rules = [F.when(n % 3 == 0, n), F.when(n % 3 == 1, n), F.when(n % 3 > 0, n), F.when(n % 3 > 0, n)]
    stages = None
    for i, r in enumerate(rules):
        one = c.select(F.lit(i).cast("bigint").alias("stage"), "clip", r.alias("island"))
        stages = one if stages is None else stages.union(one)
    return assembly.best_stage(stages)


@query(
    """WITH e AS (SELECT event_id AS seq, least(user_id, event_id % 50) AS low, greatest(user_id, event_id % 50) AS high, CASE event_type WHEN 'purchase' THEN 'rejected' WHEN 'click' THEN 'refined' ELSE 'candidate' END AS kind FROM events)
SELECT low, high, arg_max(kind, seq) AS kind FROM e GROUP BY ALL HAVING arg_max(kind, seq) <> 'rejected'"""
)
def live_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of matches that come and go."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("left"), (F.col("event_id") % 50).alias("right"), F.when(F.col("event_type") == "purchase", "rejected").when(F.col("event_type") == "click", "refined").otherwise("candidate").alias("kind"), F.col("value").alias("offset"), F.lit(1.0).alias("confidence"))
    return live.live_matches(e).select("low", "high", "kind")


@query("WITH " + _EDGES + ", u AS (SELECT 0 AS stage, l, r FROM ad WHERE evidence = 'waveform' UNION ALL SELECT 1, l, r FROM ad WHERE evidence = 'span' UNION ALL SELECT 2, l, r FROM ad WHERE evidence = 'timecode') SELECT DISTINCT clip FROM (SELECT l AS clip FROM u UNION SELECT r FROM u)")
def matched_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """H1, H3: clips that evidence of any kind touches."""
    e = graph.admitted(standins.line_edges(spark, sf_dir))
    return library.matched_ids(library.evidence(*(e.where(F.col("evidence") == k) for k in ("waveform", "span", "timecode"))))


@query("WITH " + _EDGES + """ SELECT l AS "left", r AS "right" FROM ad WHERE NOT EXISTS (SELECT 1 FROM (VALUES (1), (2), (3)) AS n(k) WHERE l % 11 = k AND r % 11 = k + 1)""")
def rejected_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges less rejected pairs, in whichever order those name them."""
    e = graph.admitted(standins.line_edges(spark, sf_dir)).select("left", "right")
    no = e.where((F.col("left") % 11).isin(1, 2, 3) & (F.col("right") % 11 == F.col("left") % 11 + 1)).select(F.col("right").alias("left"), F.col("left").alias("right"))
    return matching.without_rejected(e, no)


@query("""SELECT c_custkey AS clip, CASE WHEN c_custkey % 4 = 1 THEN coalesce(CAST(c_nationkey * 2 AS DOUBLE) - s_tc, CAST(NULL AS DOUBLE)) ELSE c_acctbal - s_rec END AS expected FROM customer JOIN (SELECT s_suppkey, s_nationkey * 2.0 AS s_tc, s_acctbal AS s_rec FROM supplier) ON s_suppkey = c_custkey % (SELECT count(*) FROM supplier)""")
def expected_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The offset that metadata leads one to expect: by timecode if both have one, else by date."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip"), F.when(F.col("c_custkey") % 4 == 1, F.col("c_nationkey") * 2.0).alias("tc"), F.col("c_acctbal").alias("rec"), F.col("c_custkey").alias("key"))
    n = table(spark, sf_dir, "supplier").agg(F.count(F.lit(1)).alias("n"))  # one row
    c = c.join(F.broadcast(n)).withColumn("k", F.col("key") % F.col("n"))
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), (F.col("s_nationkey") * 2.0).alias("stc"), F.col("s_acctbal").alias("srec"))
    return c.join(s, "k").select("clip", evidence.expected_offset(F.col("tc"), F.col("stc"), F.col("rec"), F.col("srec")).alias("expected"))


# Policies, evidence and the cache --------------------------------------------------------------------------------------


@query(
    "WITH "
    + _EDGES.rpartition(",\nad AS")[0]
    + """, t AS (SELECT *, greatest(CASE l % 5 WHEN 0 THEN 0.45 WHEN 1 THEN 0.7 ELSE 0.55 END, CASE WHEN r % 3 = 0 THEN 0.45 ELSE 0.55 END) AS least FROM ed)
SELECT l AS "left", r AS "right", CAST(least AS DOUBLE) AS least FROM t WHERE evidence = 'span' OR (confidence >= least AND (evidence = 'timecode' OR anchors >= 3) AND covered >= 3 AND residual <= 0.1)"""
)
def pair_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edges that hold against the stricter threshold of their two clips; some clips have one of their own."""
    l = F.col("p_partkey")
    own = table(spark, sf_dir, "part").select(l.alias("clip"), F.when(l % 5 == 0, "permissive").when(l % 5 == 1, "conservative").alias("threshold")).where("threshold IS NOT NULL")
    others = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 10_000_000).alias("clip"), F.lit("permissive").alias("threshold")).where("clip % 3 = 0")
    edges = policies.with_least_confidence(standins.line_edges(spark, sf_dir), own.unionByName(others))
    return graph.admitted(edges, F.col("least")).select("left", "right", "least")


@query(
    """WITH o AS (SELECT o_orderkey AS clip, CAST(CAST(o_orderdate AS DATE) - DATE '1970-01-01' AS DOUBLE) * 86400 AS rec, CAST(o_orderkey % 90 AS DOUBLE) AS d, o_orderkey % 2 = 0 AS dated,
CASE o_orderkey % 5 WHEN 1 THEN 'recStart' WHEN 2 THEN 'recStop' WHEN 3 THEN 'timecode' ELSE 'auto' END AS mode, CASE WHEN o_orderkey % 7 = 0 THEN 'v' WHEN o_orderkey % 3 = 0 THEN 'b' END AS tc FROM orders)
SELECT clip, mode, tc AS timecode, CASE WHEN dated THEN CASE mode WHEN 'recStop' THEN rec - d WHEN 'timecode' THEN NULL ELSE rec END END AS recording,
coalesce(CASE WHEN dated AND mode <> 'timecode' THEN TRUE END, mode IN ('auto', 'timecode') AND tc IS NOT NULL) AS known FROM o"""
)
def temporal_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whose timecode a clip goes by, how it is to be timed, and whether anything times it."""
    k = F.col("o_orderkey")
    stream = "struct<sourceTimecode:string>"
    video = F.when(k % 7 == 0, F.struct(F.lit("v").alias("sourceTimecode"))).cast(stream)
    audio = F.array(F.struct(F.lit(None).cast("string").alias("sourceTimecode")), F.struct(F.when(k % 3 == 0, "b").alias("sourceTimecode")), F.struct(F.lit("c").alias("sourceTimecode")))
    audio = F.when(k % 3 == 0, audio).cast(f"array<{stream}>")
    orders = table(spark, sf_dir, "orders")
    clips = orders.select(k.alias("clip"), F.when(k % 2 == 0, F.unix_date(F.to_date("o_orderdate")).cast("bigint") * 86_400).alias("recorded"), (k % 90).cast("double").alias("duration"), evidence.source_timecode(video, audio).alias("timecode"))
    own = orders.select(k.alias("clip"), F.when(k % 5 == 1, "recStart").when(k % 5 == 2, "recStop").when(k % 5 == 3, "timecode").alias("mode")).where("mode IS NOT NULL")
    timed = policies.resolved(clips, own, "auto").withColumn("recording", evidence.recording_anchor(F.col("mode"), F.col("recorded"), F.col("duration")))
    return timed.select("clip", "mode", "timecode", "recording", evidence.has_evidence(F.col("recording"), evidence.timecode_anchor(F.col("mode"), F.col("timecode"))).alias("known"))


@query(
    """WITH e AS (SELECT event_id AS id, event_id % 11 = 0 AS corrected, CASE WHEN event_id % 4 <> 0 THEN event_id / 64.0 END AS tc, event_id % 3 = 0 AS alone, CASE WHEN event_id % 2 = 0 THEN event_id * 977 END AS rec, event_id % 5 = 0 AS derived FROM events),
f AS (SELECT *, tc * 25 - floor(tc * 25) AS rest FROM e)
SELECT id, CAST(CASE WHEN corrected THEN 0 ELSE coalesce(tc, CASE WHEN alone THEN rec % 86400 END, 0) END AS DOUBLE) AS start, coalesce(alone AND NOT derived AND rest - 0.5 > 12.5 / 48 AND 1 - rest > 12.5 / 48, FALSE) AS past FROM f"""
)
def media_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where files' own time begins, and whether beyond the middle of a frame."""
    n = F.col("event_id")
    tc, alone = F.when(n % 4 != 0, n / 64.0), n % 3 == 0
    start = evidence.media_start(n % 11 == 0, tc, alone, F.when(n % 2 == 0, n * 977))
    return table(spark, sf_dir, "events").select(n.alias("id"), start.alias("start"), evidence.past_the_middle(alone, tc, n % 5 == 0, F.lit(48.0), F.lit(25.0)).alias("past"))


@query(
    """WITH e AS (SELECT o_custkey AS c, o_orderkey + 1000000000 AS o, CAST(CAST(o_orderdate AS DATE) - DATE '1995-01-01' AS DOUBLE) AS off FROM orders), g AS (SELECT c, least(0, min(-off)) AS first FROM e GROUP BY c)
SELECT c_custkey AS clip, c_custkey AS root, CAST(coalesce(-first, 0) AS DOUBLE) AS start FROM customer LEFT JOIN g ON c = c_custkey UNION ALL SELECT o, e.c, -off - first FROM e JOIN g ON e.c = g.c"""
)
def provisional_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and their orders as groups, by the days between an order and a fixed one."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("left"), (F.col("o_orderkey") + 1_000_000_000).alias("right"), F.datediff(F.to_date("o_orderdate"), F.lit("1995-01-01").cast("date")).alias("offset"))
    clips = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("clip")).union(o.select("right"))
    return graph.provisional(clips, o)


@query("""SELECT doc_id, strlen(text) || ':' || doc_id * 1000000 AS revision, sha256('fingerprints-6' || chr(0) || 'mel' || chr(0) || lang || chr(0) || source || chr(0) || strlen(text) || chr(0) || doc_id || text) AS key FROM documents""")
def cache_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of a cache's entries and marks of their files' states."""
    size, at = F.octet_length("text"), F.timestamp_seconds("doc_id")
    sample = fingerprints.sampled(F.encode("text", "UTF-8"))
    return table(spark, sf_dir, "documents").select("doc_id", fingerprints.revision(size, at).alias("revision"), fingerprints.key("mel", F.col("lang"), F.col("source"), size, F.col("doc_id"), sample).alias("key"))


def _cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    kind = F.when(n % 6 == 5, "log").when(n % 6 == 4, "ltc").when(n % 6 == 3, "timing").otherwise("bin")
    media = F.concat(F.when(n % 2 == 0, "/m//x/../").otherwise("/m/./"), F.col("user_id").cast("string"))
    version = F.when(n % 3 == 1, 5).otherwise(6)
    return table(spark, sf_dir, "events").select(n.cast("string").alias("key"), media.alias("media"), version.alias("version"), kind.alias("kind"), F.timestamp_seconds(n).alias("modified"), (n % 1000).alias("bytes"), F.when(n % 4 == 0, n % 77).alias("waveform_bytes"), F.col("event_type").alias("payload"))


_CACHE = "c AS (SELECT event_id AS n, user_id, event_type, CASE WHEN event_id % 6 = 5 THEN 'log' WHEN event_id % 6 = 4 THEN 'ltc' WHEN event_id % 6 = 3 THEN 'timing' ELSE 'bin' END AS kind, CASE WHEN event_id % 3 = 1 THEN 5 ELSE 6 END AS version FROM events)"


@query("WITH " + _CACHE + """ SELECT o_orderkey AS media, CAST(o_orderkey AS VARCHAR) AS key, coalesce(a.event_type, b.event_type) AS payload, a.n IS NULL AS promoted FROM orders
LEFT JOIN c a ON a.n = o_orderkey AND a.kind = 'bin' AND a.version = 6 LEFT JOIN c b ON b.n = o_orderkey + 1 AND b.kind = 'bin' AND b.version = 5 WHERE coalesce(a.event_type, b.event_type) IS NOT NULL""")
def cache_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose landmarks the cache has, those of the older version too."""
    k = F.col("o_orderkey")
    return fingerprints.load(table(spark, sf_dir, "orders").select(k.alias("media"), k.cast("string").alias("key"), (k + 1).cast("string").alias("legacy_key")), _cache(spark, sf_dir))


@query("WITH " + _CACHE + " SELECT CAST(n AS VARCHAR) AS key FROM c WHERE kind = 'log' OR (n > 1000 AND NOT (user_id % 5 = 0 AND (kind <> 'bin' OR version = 6)))")
def cache_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache without old entries and those of some files."""
    media = table(spark, sf_dir, "customer").select(F.concat(F.lit("/m/"), (F.col("c_custkey") * 5).cast("string")).alias("path"))
    media = media.union(spark.createDataFrame([("/m/0",)], "path string"))
    return fingerprints.without_media(fingerprints.pruned(_cache(spark, sf_dir), F.timestamp_seconds(F.lit(10_000)), 9_000.0), media).select("key")


@query("WITH " + _CACHE + " SELECT count(*) AS file_count, CAST(sum(n % 1000 + CASE WHEN n % 4 = 0 THEN n % 77 ELSE 0 END) AS BIGINT) AS total_bytes FROM c WHERE kind <> 'log'")
def cache_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the cache and their bytes."""
    return fingerprints.statistics(_cache(spark, sf_dir))
