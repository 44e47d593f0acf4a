"""Tables of the engine, and the figures that decide what counts as a match."""

from __future__ import annotations

from pyspark.sql import types as T

RATIONAL = "struct<value:bigint,timescale:int>"
TIMECODE = f"struct<text:string,frameNumber:bigint,frameDuration:{RATIONAL},dropFrame:boolean,derived:boolean>"
AUDIO = f"struct<sampleRate:double,channels:int,bitDepth:int,isFloat:boolean,sourceTimecode:{TIMECODE}>"
VIDEO = f"struct<width:int,height:int,frameDuration:{RATIONAL},sourceTimecode:{TIMECODE},frameRateMode:string>"
SPAN = "struct<identifier:string,partNumber:int,partCount:int>"
CLIPS = f"id string, url string, kind string, duration {RATIONAL}, audio array<{AUDIO}>, video {VIDEO}, recordedAt bigint, recordedAtSource string, sourceIdentifier string, mediaSpan {SPAN}"
LANDMARKS = "clip bigint, hash bigint, frame int"
EDGES = "left bigint, right bigint, rate double, offset double, confidence double, anchors bigint, left_start double, left_end double, covered double, residual double, points array<struct<left:double,right:double>>, evidence string"
PLACEMENTS = "island bigint, clip bigint, rate double, offset double, confidence double"
INTERVALS = "id string, source_key string, start double, duration double"


def struct_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


# Landmarks.
SAMPLE_RATE, FRAME, HOP = 8000, 1024, 512
BANDS = ((10, 32), (32, 64), (64, 128), (128, 256), (256, 486))
PEAK_SCORE, TARGET_DELTAS = 2.5, (8, 20, 36)
PEAKS = {"fast": 1, "quick": 2, "balanced": 3, "thorough": 4, "exhaustive": 5}
# Coarse matching. Frames, votes, seconds.
FRAME_SECONDS = HOP / SAMPLE_RATE
BUCKET, ANCHOR_BUCKET = 8, 40
VOTES, MARGIN = 12, 1.35
LEAST_GROUP, MOST_GROUP, MOST_GROUP_FLOOR = 2, 2.2, 48
HINT_NEAR, HINT_CLEAR = 2.0, 5.0
# Fits.
INLIER_SECONDS, SLOPES, LEAST_SPAN = 0.16, (0.98, 1.02), 3.0
DRIFT_SPAN, DRIFT_ANCHORS = 600.0, 50
# Which edges join clips.
CONFIDENCE, ANCHORS, COVERED, RESIDUAL = 0.55, 3, 3.0, 0.1
CANDIDATE_CONFIDENCE, WEAK_CYCLE = 0.45, 0.85
THRESHOLDS = {"permissive": 0.45, "balanced": 0.55, "conservative": 0.70}
REJECTED_RADIUS = 1.5
DAY_GATE = 57_600
TIMECODE_CONFIDENCE, SPAN_CONFIDENCE, SPAN_ANCHORS = 0.95, 1.0, 100
IRLS_ROUNDS = 4
