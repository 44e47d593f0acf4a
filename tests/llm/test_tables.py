"""Operators that relate rows: decontamination, URL reputation, WARC, near duplicates."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tests.llm.cases import frame, rows, sentence
from tidemark.llm import decontamination, jaccard_join, shared, url_reputation, warc
from tidemark.llm.shared import scratch

# Decontamination -------------------------------------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_contamination(text, items):
    w, hit, found = plain_words(text), set(), set()
    for item, body in items:
        v = plain_words(body)
        m = min(10, len(v))
        if item is None or not m:
            continue
        windows = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)}
        for p in range(len(w) - m + 1):
            if tuple(w[p : p + m]) in windows:
                hit |= set(range(p, p + m))
                found.add(str(item))
    return len(w), len(hit), sorted(found)


@pytest.fixture(params=[100_000, 0], ids=["broadcast", "shuffle"])
def limits(request, monkeypatch):
    monkeypatch.setattr(decontamination, "BROADCAST_ROWS", request.param)
    monkeypatch.setattr(decontamination, "BROADCAST_KEYS", request.param)


def test_contamination_is_what_plain_windows_find(spark, limits):
    rng = random.Random(11)
    items = [(i, sentence(rng, rng.randint(10, 40))) for i in range(12)]
    items += [(12, sentence(rng, 7)), (13, sentence(rng, 3)), (14, "zebra"), (15, ""), (16, None), (None, sentence(rng, 20)), (17, "a a a a a a a a a a a a"), items[0]]
    docs = rows(11)
    for k in range(60):
        _, body = items[rng.randrange(len(items))]
        v = (body or "").split()
        a, n = rng.randrange(max(1, len(v))), rng.randint(1, 25)
        docs.append((100 + k, " ".join([sentence(rng, rng.randint(0, 20)), *v[a : a + n], sentence(rng, rng.randint(0, 20))]).upper()))
    docs += [(300, "a " * 40), (301, "the zebra, twice: zebra")]
    got = decontamination.contamination(frame(spark, docs, "items lang"), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in docs)
    for r in got:
        assert (r.n_words, r.n_hit, r["items"]) == plain_contamination(r.text, items), r.doc_id
        assert r.contaminated == (r.n_hit > 0) and r.n_items == len(r["items"]) and r.lang == "kept"
    clean = decontamination.decontaminated(frame(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()
    assert Counter(r.doc_id for r in clean) == Counter(r.doc_id for r in got if not r.contaminated)


def test_contamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontamination.contamination(frame(spark, []), none).collect() == []
    assert {r.n_hit for r in decontamination.contamination(frame(spark, rows()), none).collect()} == {0}


# URLs ------------------------------------------------------------------------------------------------------------------


def plain_url(url):
    m = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for verdict, h, p in url_reputation.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, best


def test_hosts_rules_and_bounds(spark):
    urls = [None, "", "nothing", "http://", "HTTP://Www.Example.ORG/es/1?x#y", "https://example.org/en/12", "https://example.org/en/2", "a://b.com/fr/", "a://b.com/de/x", "a://com/de/", "a://xcom/de/", "x://h?u://k/de/", "x://ÄB.net#f/g", "u://ex.org:80/es/"]
    urls += [f"https://bad.example.net/p/{i}" for i in range(40)] + [f"https://good.example.net/p/{i}" for i in range(40)] + [f"https://other{i}.example.net/" for i in range(5)]
    outcomes = [(u, int("good" in u)) for u in urls if u and (".net/p/" in u)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r.page_id: r for r in url_reputation.judged(pages, spark.createDataFrame(outcomes, "url string, outcome int")).collect()}
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, best = plain_url(u)
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, best and best[0])
        if best:
            assert got[i].verdict == best[1]
        elif ".example.net" in host:
            assert got[i].verdict == ("block" if host.startswith("bad") else "allow")
    assert got[urls.index("https://other0.example.net/")].reputation == pytest.approx(0.5, abs=0.1)
    mostly = [(f"https://h{i % 20}.example.net/{i}", int(i % 10 > 0 and (i % 20 < 19 or i % 40 == 19))) for i in range(4000)]  # h0 and h10 have bad pages only, h19 as many bad as good ones, the others good ones
    worse = url_reputation.judged(spark.createDataFrame([(u,) for u, _ in mostly], "url string"), spark.createDataFrame(mostly, "url string, outcome int")).select("host", "verdict").distinct().collect()
    assert {r.host for r in worse if r.verdict == "block"} == {"h19.example.net"} | {f"h{i}.example.net" for i in (0, 10)} and len(worse) == 20
    again = url_reputation.judged(pages.union(pages).withColumnRenamed("page_id", "Host"), None).collect()
    assert len(again) == 2 * len(urls) and {r.verdict for r in again if r.rule is None} == {"allow"}
    assert url_reputation.judged(pages.limit(0), spark.createDataFrame([], "url string, outcome int")).collect() == []


def test_registered_domains(spark):
    hosts = {"a.b.example.co.uk": "example.co.uk", "example.com": "example.com", "x.example.com:80": "example.com", "u@www.d.net": "d.net", "localhost": "localhost", "": ""}
    df = spark.createDataFrame([(h,) for h in hosts], "host string")
    assert {r.host: r.d for r in df.select("host", url_reputation.domain_of(df.host).alias("d")).collect()} == hosts


# WARC ------------------------------------------------------------------------------------------------------------------


def pages(spark):
    big, other = "x" * 1500, "ü" * 600
    data = [(0, "http://a/", big), (1, "http://b/", big), (2, "http://c/\r\nx: y", "small"), (3, "http://d/", "small"), (4, None, None), (5, "http://e/", ""), (6, "http://f/", other), (7, "http://g/", other), (8, "http://h/", big), (None, "http://i/", big), (9, "http://j/", "WARC/1.1\r\n\r\nWARC-Type: x\r\n" * 60)]
    return data, spark.createDataFrame(data, "page_id bigint, target_uri string, html string").selectExpr("page_id", "concat('urn:page:', coalesce(cast(page_id AS string), '')) AS record_id", "target_uri", "encode(html, 'utf-8') AS payload")


@pytest.mark.parametrize("packed", ["none", "gzip"])
def test_archives_come_back(spark, packed):
    data, rows_ = pages(spark)
    path = scratch(spark, "warc-test")
    warc.archived(warc.with_revisits(rows_, "page_id"), path, compression=packed, maxFileBytes="2000")
    got = {r.record_id: r for r in warc.read(spark, path).collect()}
    assert len(got) == len(data)
    for page, url, html in data:
        r, body = got[f"urn:page:{'' if page is None else page}"], (html or "").encode()
        same = [p for p, _, h in data if (h or "") == (html or "") and p is not None]
        again = len(body) >= 1000 and page != max(same)
        assert r.record_type == ("revisit" if again else "response") and r.payload_length == len(body)
        assert r.refers_to == (f"urn:page:{max(same)}" if again else None)
        assert r.payload is None if again else bytes(r.payload) == body
        assert (r.target_uri or "") == (url or "").replace("\r\n", "%0D%0A")
    heads = warc.read(spark, path, "record_id string, record_type string, payload_digest string")
    assert heads.where("record_type = 'revisit'").count() == sum(r.record_type == "revisit" for r in got.values())
    assert warc.read(spark, path, recordTypes="revisit").where("target_uri LIKE 'http://a%'").count() == 1
    assert warc.read(spark, path, uriPrefix="http://zzz").count() == 0


def test_content_type_is_that_of_the_column(spark):
    path = scratch(spark, "warc-type")
    warc.archived(warc.with_revisits(pages(spark)[1], "page_id"), path)
    kinds = Counter(r.content_type for r in warc.read(spark, path).collect() if r.record_type == "response")
    for kind, n in kinds.items():
        assert kind.startswith("text/") and warc.read(spark, path, recordTypes="response").where(F.col("content_type") == kind).count() == n
    assert warc.read(spark, path, recordTypes="response").where("content_type LIKE 'text/%'").count() == sum(kinds.values()) > 0


def test_files_outside_the_manifest_are_not_read(spark, tmp_path):
    _, rows_ = pages(spark)
    path = f"file://{tmp_path}/w"
    warc.archived(warc.with_revisits(rows_, "page_id"), path)
    before = warc.read(spark, path).count()
    (tmp_path / "w" / "part-left-behind.warc").write_bytes(b"not a record")
    assert warc.read(spark, path).count() == before
    empty = f"file://{tmp_path}/e"
    warc.archived(warc.with_revisits(rows_.limit(0), "page_id"), empty)
    assert warc.read(spark, empty).collect() == []


# Near duplicates -------------------------------------------------------------------------------------------------------


def shingles(text, n):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def plain_components(data, n, num, den):
    sets = [shingles(t, n) for _, t in data]
    parent = list(range(len(data)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            c = len(a & sets[j])
            if a and sets[j] and den * c >= num * (len(a) + len(sets[j]) - c):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(data):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return Counter((d, len(sets[i]), least.get(find(i)) if sets[i] else d) for i, (d, _) in enumerate(data)), [find(i) for i in range(len(data))]


def near_copies(seed):
    rng = random.Random(seed)
    data = rows(seed)
    base = sentence(rng, 200).split()
    common = sentence(rng, 60)
    for i in range(60):  # one large group, at many distances
        w = list(base)
        for _ in range(rng.randint(0, 8)):
            w[rng.randrange(len(w))] = rng.choice("xyzuvw") * 3
        data.append((1000 + i, " ".join(w)))
    for i in range(25):
        data.append((2000 + i, common + " " + sentence(rng, rng.randint(0, 30))))
    data += [(3000 + i, base_) for i, base_ in enumerate([" ".join(base)] * 15)]
    data += [(4000, "a b"), (4001, "A  B"), (4002, "a"), (4003, "a b c"), (4004, "a\u00a0b c"), (None, " ".join(base))]
    rng.shuffle(data)
    return data


@pytest.mark.parametrize(("n", "num", "block"), [(3, 90, 500), (5, 80, 3)])
def test_components_are_those_of_all_pairs(spark, monkeypatch, n, num, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)  # a small one deals frequent n-grams out
    monkeypatch.setattr(shared, "HOT_ROWS", block)  # a small one deals large components and groups of copies out
    data = near_copies(21)
    got = Counter((r.doc_id, r.n_shingles, r.component) for r in jaccard_join.linked(frame(spark, data, "node root").repartition(5), n=n, num=num).collect())
    assert got == plain_components(data, n, num, 100)[0]


@pytest.mark.parametrize("tile", [1000, 20])
def test_no_link_inside_a_component_is_lost(spark, monkeypatch, tile):
    monkeypatch.setattr(jaccard_join, "TILE_NODES", tile)  # a small one deals the large group out
    data = near_copies(24)
    sets = [shingles(t, 3) for _, t in data]

    def alike(a, b):
        return bool(a) and 100 * len(a & b) >= 90 * len(a | b)

    got = Counter((r.doc_id, r.n_links) for r in jaccard_join.linked(frame(spark, data).repartition(5)).collect())
    assert got == Counter((d, sum(alike(sets[i], s) for j, s in enumerate(sets) if j != i)) for i, (d, _) in enumerate(data))
    found, members = jaccard_join.links(frame(spark, data).repartition(5))
    want = Counter(len(a & b) for i, a in enumerate(set(sets)) for j, b in enumerate(set(sets)) if j < i and alike(a, b))
    rows = found.collect()
    assert Counter(r.common for r in rows) == want and len({(r.a, r.b) for r in rows}) == len(rows)
    assert all(r.a < r.b for r in rows) and members.count() == len(data)


@pytest.mark.parametrize("keys", [500_000, 0])
def test_one_row_of_each_group_stays(spark, monkeypatch, keys):
    monkeypatch.setattr(jaccard_join, "BROADCAST_KEYS", keys)  # without any, rows are shuffled
    data = near_copies(22)
    _, groups = plain_components(data, 5, 80, 100)
    want, best = [], {}
    for (d, t), g in zip(data, groups, strict=True):
        if shingles(t, 5):
            best.setdefault(g, []).append((d is None, d or 0, t))
        else:
            want.append(d)
    want += [None if x[0] else x[1] for x in (min(v, key=lambda v: (v[0], v[1])) for v in best.values())]
    got = jaccard_join.deduplicated(frame(spark, data, "lang digest")).collect()
    assert Counter(r.doc_id for r in got) == Counter(want) and got[0].lang == "kept"


def test_no_documents(spark):
    assert jaccard_join.linked(frame(spark, [])).collect() == []


def test_words_are_hashed_alike_in_any_blocks():
    import pyarrow as pa

    rng = random.Random(23)
    texts = [None if rng.random() < 0.05 else "".join(rng.choice(["a", "B", "b", " ", "\n", "é", "\x85", "\x0b", "日"]) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    s = jaccard_join.Shingler(3)
    one = s(pa.array(texts, pa.string()))
    names = {}
    for t, g in zip(texts, one, strict=True):
        assert names.setdefault(shingles(t, 3), g.tobytes()) == g.tobytes() and len(g) == len(shingles(t, 3))
    assert len(set(names.values())) == len(names)
    s.BLOCK = 5
    assert all((a == b).all() for a, b in zip(one, s(pa.array(texts, pa.string())), strict=True))
    assert jaccard_join.common(jaccard_join.packed(one[0]), jaccard_join.packed(one[0])) == len(one[0])
