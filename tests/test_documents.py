"""Documents of other kinds: nested timelines, OTIO, AAF as JSON, saved results, probes."""

import json


from tests.test_operators import ITEMS
from tidemark.operators import graph
from tidemark.sinks import documents
from tidemark.sources import timelines

NESTED = """<?xml version="1.0"?><xmeml version="5"><sequence id="outer"><name>o</name><rate><timebase>25</timebase><ntsc>FALSE</ntsc></rate><media><video><track>
<clipitem id="n"><name>n</name><start>100</start><end>-1</end><in>25</in><out>75</out><sequence id="inner"><name>i</name><rate><timebase>25</timebase></rate><media><video><track>
<clipitem id="c"><name>c</name><start>0</start><end>50</end><in>10</in><out>60</out><file id="f"><pathurl>file:///m/c.mov</pathurl></file></clipitem>
<clipitem id="d"><name>d</name><enabled>FALSE</enabled><start>50</start><end>100</end><in>0</in><out>50</out><file id="f"/></clipitem></track></video></media></sequence></clipitem>
<transitionitem><start>140</start><end>150</end><alignment>end</alignment></transitionitem></track></video></media></sequence></xmeml>"""


def test_nested_sequences_are_cut_to_their_window():
    doc = timelines.parse(NESTED)
    assert [(e["item"], e["start"], e["end"], e["source_in"], e["source_out"], e["enabled"]) for e in doc.edits] == [("n/c", 4.0, 5.0, 1.4, 2.4, True), ("n/d", 5.0, 6.0, 0.0, 1.0, False)]
    assert len(doc.transitions) == 1 and {e["path"] for e in doc.edits} == {"/m/c.mov"}


def test_edits_of_a_folder(spark):
    df = spark.createDataFrame([("/a.xml", bytearray(NESTED.encode())), ("/b.xml", bytearray(b"<x/>"))], "path string, content binary")
    got = timelines.edits_of(df).collect()
    assert sorted((r.document, r.item, r.error is None) for r in got if r.item) == [("/a.xml", "n/c", True), ("/a.xml", "n/d", True)] and any(r.document == "/b.xml" and r.error for r in got)


def test_other_formats(spark, tmp_path):
    otio = json.loads(documents.otio("p", ITEMS))
    kinds = [[c["OTIO_SCHEMA"] for c in t["children"]] for t in otio["tracks"]["children"]]
    assert kinds == [["Gap.1", "Clip.1"], ["Gap.1", "Clip.1"], ["Clip.1"]] and otio["tracks"]["children"][2]["children"][0]["effects"][0]["time_scalar"] == 1.001
    manifest = documents.aaf_manifest("p", ITEMS)
    back = timelines.aaf_edits(spark.createDataFrame([("/p.json", manifest)], "path string, text string")).collect()
    assert sorted((r.media, r.path, r.start, r.end, r.source_in) for r in back) == sorted((i["kind"], i["path"], i["start"], i["start"] + i["duration"], i["source_in"]) for i in ITEMS)
    items = spark.createDataFrame(ITEMS)
    made = documents.export(items, "p", str(tmp_path))
    assert [m.rpartition("/")[2] for m in made] == ["p.xml", "p.fcpxml", "p.otio", "p.aaf.json"] and len(list(tmp_path.iterdir())) == 4


def test_saved_results(spark, tmp_path):
    e = spark.createDataFrame([(1, 2, 1.0, -5.0, 0.9, 100, 0.0, 60.0, 60.0, 0.01, [], "waveform")], "left bigint, right bigint, rate double, offset double, confidence double, anchors bigint, left_start double, left_end double, covered double, residual double, points array<struct<left:double,right:double>>, evidence string")
    clips = spark.createDataFrame([(1, "/a", "video"), (2, "/b", "audio"), (3, "/c", "audio")], "clip bigint, url string, kind string")
    placed = graph.stage(clips.select("clip"), e)
    documents.save(f"{tmp_path}/r.json", documents.result_json(placed, clips))
    r = timelines.saved_results(spark, f"file://{tmp_path}/r.json").first()
    assert r.unmatched == ["3"] and [(p.clipID, round(p.offset, 6)) for p in r.islands[0].placements] == [("1", 0.0), ("2", 5.0)] and len(r.clips) == 3


def test_probes(spark):
    j = json.dumps({"format": {"duration": "2.5"}, "streams": [{"index": 0, "codec_type": "video", "width": 4, "height": 2, "avg_frame_rate": "30000/1001", "tags": {"timecode": "01:00:00:00"}}, {"index": 1, "codec_type": "audio", "sample_rate": "48000", "channels": 2, "avg_frame_rate": "0/0"}]})
    got = timelines.probes(spark.createDataFrame([("/a", j), ("/b", "no")], "path string, json string")).orderBy("stream").collect()
    assert [(r.kind, r.duration, r.channels, r.timecode, r.fps and round(r.fps, 2)) for r in got] == [("video", 2.5, None, "01:00:00:00", 29.97), ("audio", 2.5, 2, None, None)]
    assert timelines.expand(["/b.wav", "/a.wav", "/b.wav", "/t.xml"]) == (["/a.wav", "/b.wav"], "/t.xml")
