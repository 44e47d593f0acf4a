"""Rational time, frame rates and SMPTE timecode as column expressions.

A rational time is a struct (value, timescale) or two columns; seconds are doubles. What can't be known is null, never guessed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Frames a second that are standard, as numerator and denominator, in the order in which ties are decided.
STANDARD_RATES = ((24000, 1001), (24, 1), (25, 1), (30000, 1001), (30, 1), (48000, 1001), (48, 1), (50, 1), (60000, 1001), (60, 1), (120, 1))
#: A nominal rate with dropped labels, and how many labels a minute drops.
DROPPED = {30: 2, 60: 4}
SLIP_SECONDS, SLIP_DUST = 0.016, 1e-9
RATE_TOLERANCE = 0.001


def half_away(x: Column) -> Column:
    """Round half away from zero to a whole number."""
    return (F.signum(x) * F.floor(F.abs(x) + 0.5)).cast("long")


def seconds_of(value: Column, timescale: Column) -> Column:
    """B1: seconds of a rational time."""
    return value.cast("double") / timescale


def micros_of(seconds: Column) -> Column:
    """B2: seconds as whole microseconds."""
    return half_away(seconds * 1e6)


def nominal_fps(value: Column, timescale: Column) -> Column:
    """Whole frames a second of a frame duration, null outside 1 to 120."""
    n = half_away(timescale.cast("double") / F.when(value > 0, value))
    return F.when((timescale > 0) & n.between(1, 120), n)


def dropped_labels(nominal: Column) -> Column:
    out = F.lit(None).cast("long")
    for n, d in DROPPED.items():
        out = F.when(nominal == n, F.lit(d).cast("long")).otherwise(out)
    return out


def frames_of_label(h: Column, m: Column, s: Column, f: Column, nominal: Column, drop_frame: Column) -> Column:
    """Frame number of claimed components; null out of range, for skipped labels, and for drop-frame at other rates."""
    counted = (h * 3600 + m * 60 + s) * nominal + f
    drop, minutes = dropped_labels(nominal), h * 60 + m
    skipped = (s == 0) & (m % 10 != 0) & (f < drop)
    dropped = F.when(~skipped, counted - drop * (minutes - F.floor(minutes / 10)))
    inside = h.between(0, 23) & m.between(0, 59) & s.between(0, 59) & (f >= 0) & (f < nominal)
    return F.when(inside, F.when(drop_frame, dropped).otherwise(counted))


def frames_of_text(text: Column, nominal: Column) -> Column:
    """Frame number of `HH:MM:SS:FF`, with `;` before the frames for drop-frame; null for anything else."""
    part = [F.try_to_number(F.substring(text, i, 2), F.lit("99")).cast("long") for i in (1, 4, 7, 10)]
    good = text.rlike(r"^[0-9]{2}:[0-9]{2}:[0-9]{2}[:;][0-9]{2}\z")
    return F.when(good, frames_of_label(*part, nominal, F.substring(text, 9, 1) == ";"))


def label_parts(elapsed: Column, nominal: Column, drop_frame: Column) -> tuple[Column, Column, Column, Column]:
    """Hours, minutes, seconds and frames that are shown for an elapsed count, which wraps after a day."""
    drop = F.when(drop_frame, dropped_labels(nominal)).otherwise(F.lit(0).cast("long"))
    block, minute = 600 * nominal - 9 * drop, 60 * nominal
    e = F.pmod(elapsed, 144 * block)
    rest = e % block
    later = rest - minute
    stride = minute - drop
    inside = F.when(rest < minute, rest).otherwise((F.floor(later / stride) + 1) * minute + F.pmod(later, stride) + drop)
    n = F.pmod(F.when(drop > 0, F.floor(e / block) * 600 * nominal + inside).otherwise(elapsed), 86400 * nominal)
    total = F.floor(n / nominal)
    return F.floor(total / 3600) % 24, F.floor(total / 60) % 60, total % 60, n % nominal


def label_of(frame: Column, nominal: Column, drop_frame: Column) -> Column:
    """Label of a frame number; null for a negative one. Drop-frame holds only at rates that have it."""
    drops = drop_frame & dropped_labels(nominal).isNotNull()
    h, m, s, f = label_parts(frame, nominal, drops)
    return F.when((frame >= 0) & nominal.isNotNull(), F.format_string("%02d:%02d:%02d%s%02d", h, m, s, F.when(drops, ";").otherwise(":"), f))


def labelled(df: DataFrame, frame: str, nominal: str, drop_frame: str, name: str = "label") -> DataFrame:
    """B6, B7 of a table: df with the label of a frame number's column. The steps of `label_parts` are columns of their own, each worked out once
    a row, where the expression `label_of` has them in every part of the label."""
    own = [f"__{x}" for x in ("drop", "block", "stride", "e", "rest", "n", "total")]
    drop, block, stride, e, rest, n, total = own
    fps, minute = F.col(nominal), 60 * F.col(nominal)
    df = df.withColumn(drop, F.when(F.col(drop_frame), F.coalesce(dropped_labels(fps), F.lit(0))).otherwise(F.lit(0)).cast("long"))
    df = df.withColumns({block: 600 * fps - 9 * F.col(drop), stride: minute - F.col(drop)})
    df = df.withColumn(e, F.pmod(F.col(frame), 144 * F.col(block)))
    df = df.withColumn(rest, F.col(e) % F.col(block))
    later = F.col(rest) - minute
    inside = F.when(F.col(rest) < minute, F.col(rest)).otherwise((F.expr(f"(`{rest}` - 60 * `{nominal}`) div `{stride}`") + 1) * minute + later % F.col(stride) + F.col(drop))
    shown = F.when(F.col(drop) > 0, F.expr(f"`{e}` div `{block}`") * 600 * fps + inside).otherwise(F.col(frame))
    df = df.withColumn(n, F.pmod(shown, 86400 * fps)).withColumn(total, F.expr(f"`{n}` div `{nominal}`"))

    def two(x: Column) -> Column:
        return F.lpad(x.cast("string"), 2, "0")

    t = F.col(total)
    text = F.concat(two(F.expr(f"`{total}` div 3600") % 24), F.lit(":"), two(F.expr(f"`{total}` div 60") % 60), F.lit(":"), two(t % 60), F.when(F.col(drop) > 0, ";").otherwise(":"), F.when(F.col(n) % fps < 10, F.lit("0")).otherwise(F.lit("")), (F.col(n) % fps).cast("string"))
    return df.withColumn(name, F.when((F.col(frame) >= 0) & fps.isNotNull(), text)).drop(*own)


def counted(df: DataFrame, label: str, nominal: str, name: str = "frame") -> DataFrame:
    """B5 of a table: df with the frame number of a label's column, its parts each read once."""
    own = [f"__{x}" for x in "hmsf"]
    good = F.col(label).rlike(r"^[0-9]{2}:[0-9]{2}:[0-9]{2}[:;][0-9]{2}\z")
    df = df.withColumns({x: F.when(good, F.substring(label, i, 2).try_cast("long")) for x, i in zip(own, (1, 4, 7, 10), strict=True)})
    return df.withColumn(name, frames_of_label(*(F.col(x) for x in own), F.col(nominal), F.substring(label, 9, 1) == ";")).drop(*own)


def frames_of_samples(samples: Column, sample_rate: Column, value: Column, timescale: Column) -> Column:
    """Whole display frames that so many samples fill, in exact arithmetic."""
    rate = half_away(sample_rate)
    big = samples.cast("decimal(20,0)") * timescale.cast("decimal(10,0)")
    return F.when((rate > 0) & (value > 0) & (timescale > 0), F.floor(big / (rate.cast("decimal(10,0)") * value.cast("decimal(10,0)"))).cast("long"))


def standard_frame(fps: Column) -> Column:
    """(value, timescale) of the nearest standard rate within a thousandth, the first of equals; else null."""
    best = F.lit(None).cast("struct<d:double,i:int,value:int,timescale:int>")
    for i, (num, den) in enumerate(STANDARD_RATES):
        rate = num / den
        one = F.struct((F.abs(fps - rate) / rate).alias("d"), F.lit(i).alias("i"), F.lit(den).alias("value"), F.lit(num).alias("timescale"))
        best = F.least(best, F.when(F.abs(fps - rate) / rate <= RATE_TOLERANCE, one))
    return F.when(best.isNotNull(), F.struct(best["value"].alias("value"), best["timescale"].alias("timescale")))


def slips(duration: Column, rate: Column) -> Column:
    """Whether a rate moves the end of a clip by as much as is corrected."""
    return F.abs(duration * (rate - 1)) + SLIP_DUST >= SLIP_SECONDS


def sequence_fps(value: Column, timescale: Column) -> Column:
    """Frames a second, on an NTSC rate if that is within 0.02."""
    fps = timescale.cast("double") / value
    out = fps
    for n in (24, 30, 60):
        ntsc = n * 1000 / 1001
        out = F.when(F.abs(fps - ntsc) < 0.02, F.lit(ntsc)).otherwise(out)
    return out


def snapped(frames: Column, samples_per_frame: Column) -> tuple[Column, Column]:
    """Whole frames and what is left of them; within half a sample of a whole frame nothing is left."""
    near = half_away(frames)
    close = F.abs(frames - near) * samples_per_frame <= 0.5
    whole = F.floor(frames)
    return F.when(close, near).otherwise(whole), F.when(close, 0.0).otherwise(frames - whole)


def eightieths(fraction: Column) -> Column:
    """Eightieths of a frame."""
    return half_away(fraction * 80)


def grid_time(seconds: Column, value: Column, timescale: Column) -> Column:
    """A time on the frame grid if it is within a microsecond of a frame, else whole microseconds."""
    frames = half_away(seconds * timescale / value)
    on = F.abs(seconds - frames * value / timescale) <= 1e-6
    return F.when(on, F.struct((frames * value).cast("long").alias("value"), timescale.cast("long").alias("timescale"))).otherwise(F.struct(micros_of(seconds).alias("value"), F.lit(1_000_000).cast("long").alias("timescale")))


def whole_frames(seconds: Column, frame_seconds: Column, up: bool) -> Column:
    """Whole frames up to or down from a time."""
    n = seconds / frame_seconds
    return (F.ceil(n) if up else F.floor(n)).cast("long")


def frames_covering(seconds: Column, frame_seconds: Column) -> Column:
    """Frames that a duration needs, one at least."""
    return F.greatest(F.lit(1).cast("long"), F.ceil(seconds / frame_seconds - 1e-6).cast("long"))


def shifted_frame(fps: Column, seconds: Column, shift: Column) -> Column:
    """The frame of a shifted time; at an exact half the side of the time that wasn't moved decides."""
    def rounded(t: Column) -> Column:
        return F.round(t, 5)

    moved, still = rounded(seconds + shift) * fps, rounded(seconds) * fps
    tie = F.abs(moved - F.floor(moved) - 0.5) < 1e-9
    down = still < half_away(still)
    return F.when(tie & down, F.floor(moved)).otherwise(F.floor(moved + 0.5)).cast("long")


def fraction_seconds(text: Column) -> Column:
    """Seconds of `n/ds` or `ns`; what can't be read is 0."""
    bare = F.regexp_replace(F.trim(text), "s$", "")
    top, bottom = F.expr("0"), None
    parts = F.split(bare, "/")
    top, bottom = F.get(parts, F.lit(0)).try_cast("double"), F.get(parts, F.lit(1)).try_cast("double")
    one = F.when(F.size(parts) == 1, top).otherwise(F.when((F.size(parts) == 2) & (bottom != 0), top / bottom))
    return F.coalesce(one, F.lit(0.0))


def added(a_value: Column, a_scale: Column, b_value: Column, b_scale: Column) -> Column:
    """Exact sum of two rational times over the least common multiple of their scales, in microseconds where that is too large.

    The greatest common divisor is found by Euclid's steps: at most 46 for 32-bit numbers.
    """
    def step(pair: Column, _: Column) -> Column:
        return F.when(pair.b == 0, pair).otherwise(F.struct(pair.b.alias("a"), (pair.a % F.when(pair.b == 0, 1).otherwise(pair.b)).alias("b")))

    gcd = F.aggregate(F.sequence(F.lit(1), F.lit(46)), F.struct(a_scale.cast("long").alias("a"), b_scale.cast("long").alias("b")), step)["a"]
    scale = (a_scale.cast("long") / gcd).cast("long") * b_scale.cast("long")
    exact = F.struct((a_value * (scale / a_scale).cast("long") + b_value * (scale / b_scale).cast("long")).alias("value"), scale.alias("timescale"))
    micros = F.struct((micros_of(seconds_of(a_value, a_scale)) + micros_of(seconds_of(b_value, b_scale))).alias("value"), F.lit(1_000_000).cast("long").alias("timescale"))
    return F.when(scale <= 2**31 - 1, exact).otherwise(micros)
