"""Queries that read all rows of their tables."""

import random

import numpy as np

import __spark_entry__
from tidemark.operators import matching
from tidemark.plans import standins


def found(name):
    return __spark_entry__.queries()[name]


def test_every_byte_of_a_document_is_a_sample(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(standins, "TAPE_BLOCK", 64)
    monkeypatch.setattr(standins, "SHIFTS", (0, 70, 333))
    rng = random.Random(4)
    docs = [(i, None if i % 50 == 0 else "".join(rng.choice("abé\n ") for _ in range(rng.randint(0, 200)))) for i in range(600)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    loud = {float(x): i for i, x in enumerate(np.random.default_rng(1).normal(size=256).astype(np.float32))}
    got = {}
    for r in standins.tapes(spark, str(tmp_path)).orderBy("clip", "first").collect():
        held = got.setdefault(r.clip, bytearray())
        assert r.first == len(held)
        held.extend(loud[x] for x in r.samples)
    for scene in range(3):
        whole = b"".join((t or "").encode() for i, t in docs if i // 250 == scene)
        assert [bytes(got[scene * 10 + k]) for k in range(3)] == [whole[s:] for s in (0, 70, 333)]


def test_all_orders_are_videos_or_recorders(spark, monkeypatch):
    rng = random.Random(5)
    data = [(i, rng.randrange(9), s := rng.randrange(900), s + rng.randint(1, 120)) for i in range(150)]
    monkeypatch.setattr(standins, "order_intervals", lambda *_: spark.createDataFrame(data, "id long, source long, start long, end long"))
    audio, first = {}, {}
    for v, island, a, b in (r for r in data if r[0] % 3 == 0):
        met = [(i, i % 4, i * 31 % 1009, max(a, c), min(b, d)) for i, s, c, d in data if i % 3 and s == island and c < b and a < d]
        if met:
            i, lane, _, c, d = min(met, key=lambda m: (m[1], m[3] - m[4], m[2], m[0]))
            audio[v], first[v] = (i, lane, c, d), min(met, key=lambda m: (m[2], m[0]))[0]
    assert {r.id: tuple(r)[1:] for r in found("replaced_audio")(spark, "").collect()} == audio
    assert {r.id: r.recorder for r in found("first_recorder")(spark, "").collect()} == first


def test_all_pages_are_clips_or_edits(spark, tmp_path):
    urls = [f"http://h/{i % 7}/{i % 11}.{'mov' if i % 2 else 'html'}" for i in range(60)]
    spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    clips = {u for i, u in enumerate(urls) if i % 3 == 0}
    want = {u for i, u in enumerate(urls) if i % 3 and u not in clips and not u.endswith(".html")}
    assert want and sorted(r.path for r in found("unresolved_media")(spark, str(tmp_path)).collect()) == sorted(want)


def test_all_customers_are_packed(spark, tmp_path):
    keys = random.Random(6).sample(range(5000), 700)
    spark.createDataFrame([(k, k % 25) for k in keys], "c_custkey long, c_nationkey int").repartition(6).write.parquet(f"{tmp_path}/customer.parquet")
    want, at = {}, 0.0
    for k in sorted(keys):
        want[k] = at
        at += k % 7 + 1.0
    assert {r.position: r.start for r in found("packed_groups")(spark, str(tmp_path)).collect()} == want


def test_every_edge_has_its_place(spark, monkeypatch):
    rng = random.Random(7)
    data = [(i, i + 9000, rng.randint(30, 50) / 50, rng.randint(3, 6), float(rng.randint(3, 9)), rng.randint(0, 8) / 100, "waveform") for i in range(2500)]
    monkeypatch.setattr(standins, "line_edges", lambda *_: spark.createDataFrame(data, "left long, right long, confidence double, anchors long, covered double, residual double, evidence string"))
    want = sorted(data, key=lambda e: (-int(e[2] * 10000 + 0.5), -e[3], -e[4], int(e[5] * 10000 + 0.5), e[0]))
    assert [r.left for r in sorted(found("edge_order")(spark, "").collect(), key=lambda r: r.n)] == [e[0] for e in want]


def test_pairs_of_many_ridge_points_are_fitted_too(spark, monkeypatch):
    """A clip that repeats what it says: more than 16,384 cells and buckets of one pair, which still has its line."""
    rows = [(7, 57, i, 8 * i, round(1.01 * 8 * i) + 100) for i in range(1500)]
    rows += [(7, 57, 10_000 + b, 40 * (20 * c + b % 20) + 5, 40 * (20 * c + b % 20) + 5 + 8 * b + 3_000) for c in range(15) for b in range(1_200)]
    rows += [(8, 58, i, 8 * i, round(1.01 * 8 * i) + 100) for i in range(1500)]
    pairs = spark.createDataFrame(rows, "left bigint, right bigint, hash bigint, lf bigint, rf bigint")
    points = matching.ridge_points(pairs, matching.histogram(pairs))
    assert points.where("left = 7").count() > 16_384
    got = {r.left: r for r in matching.ridge_fits(points).collect()}
    assert sorted(got) == [7, 8]
    for left, pdf in points.toPandas().groupby("left"):
        fit, margin = matching.ridge_line(pdf.x.to_numpy(), pdf.y.to_numpy(), pdf.cell.to_numpy(), pdf.bucket.to_numpy())
        assert got[left].margin == margin and got[left].rate == fit["rate"] and [p.right for p in got[left].points] == fit["y"].tolist()
        (again,) = matching.ridge_fits(points.where(f"left = {left}"), most=10).collect()
        assert again == got[left]
