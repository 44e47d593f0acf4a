"""The first places of every group, with ties, by distributed multi-select.

Lines of a group are ordered by a pair of numbers; lines with one pair are tied and share a place. Pairs are encoded as whole numbers
in their order. What decides a group's last place is the code of its `places`-th distinct pair, its cut. All groups search for theirs
at once: each holds a range of codes in which the cut lies, a pass counts exactly how many distinct pairs lie below the middles of the
next `STEPS` halvings, and the range shrinks. Only pairs inside the ranges go on to the next pass. Then lines beyond their group's
cut go, and what is left is sorted by ranges, which gives positions without a group ever being in one task.

Nothing that grows with the input is collected or broadcast: the driver sees the extremes of both numbers and how many lines there
are. Groups with more than one in `HOT_GROUPS` of all lines, of which there can't be more than that, get their cuts by a broadcast, so
none of their lines is dealt by group; others meet their pairs in a shuffle, where no key is hot.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.shared import dropped, settled, without

#: Halvings of a search that one pass counts for.
STEPS = 3
HOT_GROUPS = 4096
ADDED = ("pos", "place", "tied")
#: Fixed value: the most codes that pairs may have.
MOST_CODES = 1 << 62


class Codes:
    """Pairs (first, second) of whole numbers as numbers from 0 to size - 1: larger first numbers come first, then smaller second
    ones; missing ones come last and are equal to each other."""

    def __init__(self, low_first: int | None, high_first: int | None, low_second: int | None, high_second: int | None):
        self.high, self.low = high_first or 0, low_second or 0
        self.missing_first = self.high - (low_first if low_first is not None else self.high) + 1
        self.missing_second = (high_second if high_second is not None else self.low) - self.low + 1
        self.width = self.missing_second + 1
        self.size = (self.missing_first + 1) * self.width
        if self.size > MOST_CODES:
            raise ValueError(f"pairs span {self.size} codes; {MOST_CODES} are the most")

    @staticmethod
    def of(df: DataFrame, first: Column, second: Column) -> Codes:
        return Codes(*df.agg(F.min(first), F.max(first), F.min(second), F.max(second)).first())  # one row

    def code(self, first: Column, second: Column) -> Column:
        a = F.coalesce(F.lit(self.high).cast("long") - first, F.lit(self.missing_first).cast("long"))
        b = F.coalesce(second - F.lit(self.low).cast("long"), F.lit(self.missing_second).cast("long"))
        return a * F.lit(self.width).cast("long") + b


def cuts(pairs: DataFrame, size: int, places: int, steps: int = STEPS) -> DataFrame:
    """(g, cut): the code of the `places`-th pair of each group of pairs (g, code; each once) that has so many.

    Of a group's range (low, high], up to low there are `below` < places pairs and up to high places or more: so the search ends at
    the cut. A group's counts are partial sums in all tasks that hold its pairs.
    """
    enough = pairs.groupBy("g").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= places).select("g")
    start = {"low": F.lit(-1).cast("long"), "high": F.lit(size - 1).cast("long"), "below": F.lit(0).cast("long")}
    left, old = pairs.select("g", "code").join(enough, "g", "left_semi").withColumns(start), None
    for _ in range(max(1, math.ceil(math.log2(max(2, size)) / steps))):
        left = settled(left, "pairs-left")
        if old is not None:
            dropped(left.sparkSession, old)
        old = left
        parts = 1 << steps

        def bound(i: int, parts: int = parts) -> Column:
            """The upper end of part i of a range, without a product that could overflow."""
            return F.col("low") + F.expr(f"(high - low) div {parts} * {i} + (high - low) % {parts} * {i} div {parts}")

        counts = left.groupBy("g").agg(F.max("low").alias("low"), F.max("high").alias("high"), F.max("below").alias("below"), *(F.sum((F.col("code") <= bound(i)).cast("long")).alias(f"c{i}") for i in range(1, parts)))
        reached = [(F.col("below") + F.col(f"c{i}")) >= places for i in range(1, parts)]
        part = F.coalesce(*(F.when(r, F.lit(i)) for i, r in enumerate(reached)), F.lit(parts - 1))
        narrowed = counts.withColumn("part", part)
        low = F.coalesce(*(F.when(F.col("part") == i, bound(i)) for i in range(1, parts)), F.col("low"))
        high = F.coalesce(*(F.when(F.col("part") == i, bound(i + 1)) for i in range(parts - 1)), F.col("high"))
        below = F.col("below") + F.coalesce(*(F.when(F.col("part") == i, F.col(f"c{i}")) for i in range(1, parts)), F.lit(0))
        narrowed = narrowed.select("g", low.alias("low"), high.alias("high"), below.alias("below"))
        left = left.select("g", "code").join(narrowed, "g").where((F.col("code") > F.col("low")) & (F.col("code") <= F.col("high")))
    return left.select("g", F.col("high").alias("cut"))


def ranked(df: DataFrame, group: list[str], first: str, second: str, order: list[str], places: int = 5) -> DataFrame:
    """Rows of df whose place in their group is `places` or less, with pos, place and tied.

    A place is 1 plus the group's distinct earlier pairs: by `first`, larger ones first, then by `second`, smaller ones first, missing
    ones last and equal. pos counts the group's rows in that order and then by `order`, ascending, missing ones last; rows that are
    equal in all of it, which may be many, are counted in any order. tied: how many of the group's rows have the row's pair. Missing
    values of a group's columns are values like others. Columns named like the added ones are replaced; without rows there are none.
    """
    if places < 1:
        raise ValueError("places has to be 1 or more")
    kept = without(df, ADDED)
    names = kept.columns
    # The caller's columns stand beside the operator's own under other names, so none can clash.
    of = {c: f"c{i}" for i, c in enumerate(df.columns)}
    lines = df.select(*(df[f"`{c}`"].alias(n) for c, n in of.items()))
    g = F.struct(*(F.col(of[c]) for c in group)) if group else F.struct(F.lit(0).alias("all"))
    one, two = F.col(of[first]).cast("long"), F.col(of[second]).cast("long")
    codes = Codes.of(lines, one, two)
    needed = list(dict.fromkeys([*(of[c] for c in names), *(of[c] for c in order)]))
    lines = lines.select(*needed, g.alias("g"), codes.code(one, two).alias("code"))

    pairs = settled(lines.groupBy("g", "code").agg(F.count(F.lit(1)).alias("tied")), "pairs")
    found = cuts(pairs, codes.size, places)
    of_group = Window.partitionBy("g")  # of a group's first pairs: `places` rows at most
    first_pairs = pairs.join(found, "g", "left").where(F.col("cut").isNull() | (F.col("code") <= F.col("cut")))
    first_pairs = settled(first_pairs.select("g", "code", "tied", F.row_number().over(of_group.orderBy("code")).cast("long").alias("place")), "first-pairs")
    total = pairs.agg(F.sum("tied")).first()[0] or 0
    hot = pairs.groupBy("g").agg(F.sum("tied").alias("n")).where(F.col("n") * HOT_GROUPS > total).select("g")
    hot = settled(hot, "hot-groups")  # fewer than HOT_GROUPS rows
    # Lines of hot groups meet their group's first pairs (HOT_GROUPS * places rows at most) where they are read.
    of_hot = lines.join(F.broadcast(first_pairs.join(F.broadcast(hot), "g", "left_semi")), ["g", "code"])
    rest = first_pairs.join(F.broadcast(hot), "g", "left_anti")
    of_rest = lines.join(F.broadcast(hot), "g", "left_anti").join(rest.hint("merge"), ["g", "code"])
    chosen = settled(of_hot.unionByName(of_rest), "first-places")

    # Equal lines are told apart by where they were written, so even they are dealt to several ranges.
    chosen = chosen.withColumn("tie", F.xxhash64(F.col("_metadata.file_name"), F.col("_metadata.row_index")))
    by = [F.col("g"), F.col("code"), *(F.col(of[c]).asc_nulls_last() for c in order), F.col("tie")]
    parts = settled(chosen.repartitionByRange(*by).withColumn("range", F.spark_partition_id()), "ranges")
    earlier = F.sum("n").over(Window.partitionBy("g").orderBy("range").rowsBetween(Window.unboundedPreceding, -1))
    begun = parts.groupBy("g", "range").agg(F.count(F.lit(1)).alias("n")).withColumn("earlier", earlier).where("earlier > 0").select("g", "range", "earlier")  # the first group of a range: a row for each range at most
    place_in = F.row_number().over(Window.partitionBy("g", "range").orderBy(*by[1:]))
    done = parts.withColumn("n", place_in).join(F.broadcast(begun), ["g", "range"], "left")
    return done.select(*(F.col(of[c]).alias(c) for c in names), (F.col("n") + F.coalesce("earlier", F.lit(0))).cast("long").alias("pos"), "place", F.col("tied").cast("long").alias("tied"))


#: DuckDB: the same by window functions; crc32 by a table of 256 entries that is worked out first.
SQL = """
WITH tab AS (SELECT list(list_reduce([CAST(i AS BIGINT), 1, 2, 3, 4, 5, 6, 7, 8], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
ids AS (SELECT DISTINCT sale_id FROM sale_lines WHERE sale_id IS NOT NULL),
crc AS (SELECT sale_id, xor(4294967295, list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(sale_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]))) % 5 = 0 AS one FROM ids, tab),
l AS (SELECT s.*, coalesce(one, false) AS one, CAST(floor(100 * discount + 0.5) AS BIGINT) AS percent, CAST(floor(100 * amount + 0.5) AS BIGINT) AS amount_cents, CAST(floor(quantity / 10.0) AS BIGINT) AS tens FROM sale_lines s LEFT JOIN crc USING (sale_id)),
k AS (SELECT CASE WHEN one THEN -1 ELSE vendor_id END AS vendor_id, CAST(CASE WHEN one THEN -1 ELSE coalesce(item_id % 2, -1) END AS BIGINT) AS part, CAST(CASE WHEN one THEN -1 ELSE coalesce(100 * year(shipped_at) + month(shipped_at), -1) END AS BIGINT) AS month, sale_id, CAST(line_no AS BIGINT) AS line_no, CAST(quantity AS BIGINT) AS quantity, percent, amount_cents, tens FROM l),
w AS (SELECT *, row_number() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS LAST, percent NULLS LAST, sale_id NULLS LAST, line_no NULLS LAST, quantity NULLS LAST, amount_cents NULLS LAST) AS pos, dense_rank() OVER (PARTITION BY vendor_id, part, month ORDER BY tens DESC NULLS LAST, percent NULLS LAST) AS place, count(*) OVER (PARTITION BY vendor_id, part, month, tens, percent) AS tied FROM k)
SELECT vendor_id, part, month, pos, place, sale_id, line_no, quantity, percent, amount_cents, tied FROM w WHERE place <= 5
"""
