"""Fill-in-the-middle texts, first places of groups and the language model, against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.cases import frame, rows, sentence
from tidemark.llm import fill_in_middle, grouped_ranking, language_model, queries

# Fill in the middle ----------------------------------------------------------------------------------------------------


def plain_filled(doc_id, text):
    """The contract with a whole list of lines."""
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = [int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or re.search("<[PSM]>", text):
        return len(lines), "plain", None, None, text
    a, b = sorted((h[0] % (len(lines) + 1), h[1] % (len(lines) + 1)))
    p, m, s = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    return len(lines), *(("spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else ("psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"))


def lined(rng, n):
    return "".join(rng.choice(["\n", "a\n", "bü 😀\n", "x\r\n", "\x85y\n", "<\n", "word "]) for _ in range(n))


def texts(seed=3):
    rng = random.Random(seed)
    data = rows(seed) + [(100 + i, lined(rng, rng.randint(0, 30))) for i in range(80)]
    return [*data, (300, "a\n<M>\nb\n"), (301, "\n"), (302, "no line end"), (303, lined(rng, 30_000)), (304, "<P"), (303, lined(rng, 3))]


def test_filled_texts_are_those_of_a_plain_version_and_come_back(spark):
    data = texts()
    done = fill_in_middle.unfilled(fill_in_middle.filled(frame(spark, data, "lang FIM_form __key key c0")))
    got = Counter((r.doc_id, r.text, r.fim_units, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r.fim_output) for r in done.collect())
    assert got == Counter((d, t, *plain_filled(d, t)) for d, t in data)
    assert done.columns == ["doc_id", "text", "lang", "__key", "key", "c0", *fill_in_middle.ADDED, "fim_restored"]
    assert all(r.fim_restored == (r.text or "") and r.lang == r.c0 == "kept" for r in done.collect())
    assert {r.fim_form for r in done.collect()} == {"plain", "psm", "spm"}
    assert fill_in_middle.unfilled(fill_in_middle.filled(frame(spark, []))).collect() == []


def test_filled_texts_under_other_names_units_and_rates(spark):
    data = [(i, sentence(random.Random(i), 30)) for i in range(60)]
    clash = frame(spark, data).withColumnsRenamed({"doc_id": "fim_units", "text": "fim_output"})
    done = fill_in_middle.filled(clash, "fim_units", "fim_output", unit=r"\S+\s*|\s+", rate=50, spm_rate=100)
    assert done.columns == list(fill_in_middle.ADDED) and 10 < done.where("fim_form = 'spm'").count() < 50 and done.where("fim_form = 'psm'").count() == 0
    back = {r.fim_restored for r in fill_in_middle.unfilled(done).collect()}
    assert back == {t for _, t in data}
    for output, form in (("x", "psm"), ("<P>a<M>b<S>c", "psm"), ("<S>a<P>b", "spm"), (None, "psm"), ("a", None)):
        assert fill_in_middle.restored(output, form) is None


def test_query_of_filled_texts(spark, tmp_path):
    data = texts(5)
    frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    got = Counter(tuple(r) for r in queries.op11_fill_in_middle(spark, str(tmp_path)).collect())

    def sha(x):
        return hashlib.sha256(x.encode()).hexdigest()

    assert got == Counter((d, *plain_filled(d, t)[:4], sha(plain_filled(d, t)[4]), sha(t or "")) for d, t in data)


# First places of groups ------------------------------------------------------------------------------------------------


def plain_ranked(data, places):
    """data: (group, first, second, a, b): rows with pos, place and tied."""

    def last(x, sign=1):
        return (x is None, 0 if x is None else sign * x)

    groups, out = {}, []
    for r in data:
        groups.setdefault(r[0], []).append(r)
    for held in groups.values():
        held.sort(key=lambda r: (last(r[1], -1), last(r[2]), last(r[3]), last(r[4])))
        pairs = Counter(r[1:3] for r in held)
        place = {p: i for i, p in enumerate(dict.fromkeys(r[1:3] for r in held), 1)}
        out += [(*r, pos, place[r[1:3]], pairs[r[1:3]]) for pos, r in enumerate(held, 1) if place[r[1:3]] <= places]
    return Counter(out)


def ranked_rows(spark, data, places, steps=3, monkeypatch=None):
    df = spark.createDataFrame(data, "grp string, first bigint, second bigint, a bigint, b bigint")
    return Counter(tuple(r) for r in grouped_ranking.ranked(df, ["grp"], "first", "second", ["a", "b"], places).collect())


@pytest.mark.parametrize(("places", "wide"), [(1, 5), (3, 5), (5, 10**9)])
def test_first_places_are_those_of_a_sort(spark, places, wide):
    rng = random.Random(places)

    def maybe(x):
        return None if rng.random() < 0.1 else x

    data = [(rng.choice(["a", "a", "a", "b", "c", None]), maybe(rng.randint(-wide, wide)), maybe(rng.randint(0, 4)), maybe(rng.randint(0, 3)), rng.randint(0, 1)) for _ in range(600)]
    data += [("few", 1, 1, 1, 1), ("few", 1, 1, 1, 1), ("none", None, None, None, None), ("hot", 3, 0, 0, 0)] + [("hot", 2, 0, 0, 0)] * 300
    assert ranked_rows(spark, data, places) == plain_ranked(data, places)


def test_first_places_where_no_group_is_hot_and_none_is_known(spark, monkeypatch):
    monkeypatch.setattr(grouped_ranking, "HOT_GROUPS", 1)  # no group has more than all lines
    rng = random.Random(11)
    data = [(str(rng.randint(0, 9)), rng.randint(0, 30), rng.randint(0, 30), rng.randint(0, 9), 0) for _ in range(500)]
    assert ranked_rows(spark, data, 4) == plain_ranked(data, 4)
    assert ranked_rows(spark, [], 4) == Counter()
    df = spark.createDataFrame([(1, 2, 3, "x"), (1, 2, 3, "x")], "code bigint, g bigint, tied bigint, POS string")
    got = grouped_ranking.ranked(df, ["g"], "code", "tied", ["POS"]).collect()
    assert sorted(map(tuple, got)) == [(1, 2, 1, 1, 2), (1, 2, 2, 1, 2)]
    assert grouped_ranking.ranked(df, [], "code", "g", []).count() == 2
    with pytest.raises(ValueError):
        grouped_ranking.Codes(-(2**62), 2**62, 0, 1)


def test_cuts_are_found_whatever_a_pass_counts(spark):
    rng = random.Random(12)
    held = {g: sorted(rng.sample(range(1000), rng.randint(1, 60))) for g in range(25)}
    pairs = spark.createDataFrame([(g, c) for g, cs in held.items() for c in cs], "g int, code bigint")
    for steps in (1, 2, 4):
        assert {r.g: r.cut for r in grouped_ranking.cuts(pairs, 1000, 5, steps).collect()} == {g: cs[4] for g, cs in held.items() if len(cs) >= 5}


# Language model --------------------------------------------------------------------------------------------------------


def plain_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) + [None]


def corpus():
    """Texts in which most words follow from the one before."""
    rng = random.Random(21)
    out = []
    for i in range(300):
        w = rng.randrange(20)
        text = []
        for _ in range(rng.randint(0, 60)):
            text.append(f"W{w}")
            w = (3 * w + 1) % 20 if rng.random() < 0.8 else rng.randrange(20)
        out.append((i, " ".join(text) + (f" only{i}" if i % 5 == 0 else "") + " É\x85é" * (i % 2)))
    return out + rows(2)


@pytest.mark.parametrize("known", [131_072, 6])
def test_base_scores_are_those_of_plain_counts(spark, known):
    data = corpus()
    df = frame(spark, data, "lang LM_score row ids")
    train = F.coalesce(F.col("doc_id") % 3 != 1, F.lit(True))
    got = language_model.scored(df, train, known=known, rounds=0).collect()
    learned = [plain_words(t) for d, t in data if d is None or d % 3 != 1]
    c = Counter(w for t in learned for w in t)
    n, v = sum(c.values()), len(c)

    def of(d, t):
        w = plain_words(t)
        return d, t, len(w), sum(x in c for x in w), round(sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6), n

    assert Counter((r.doc_id, r.text, r.lm_tokens, r.lm_known, round(r.lm_base_score, 6), r.lm_train_tokens) for r in got) == Counter(of(d, t) for d, t in data)
    assert set(got[0].asDict()) == {"doc_id", "text", "lang", "row", "ids", *language_model.ADDED} and got[0].row == got[0].ids == "kept"


def test_probabilities_add_up_to_one():
    counts = language_model.Counts([(f"w{i}".encode(), 100 // (i + 1)) for i in range(30)], 700, 45, 20, None)
    model, seen = language_model.started(counts, vocabulary=12)
    assert len(seen) == 12 and seen[language_model.OTHER] == 700 - 20 - sum(c for _, c in counts.known[:10])
    trainer = language_model.Trainer(model, seen, 3)
    rng = np.random.default_rng(0)
    for _ in range(50):
        trainer.batch(*(rng.integers(0, 12, 200) for _ in range(3)))
    tables = language_model.Tables.of(model._replace(out=trainer.p[0], left=trainer.p[1], before=trainer.p[2], bias=trainer.p[3][:, 0]))
    for a, b in ((0, 0), (3, 7), (11, 1)):
        assert np.exp(tables.logs(np.full(12, a), np.full(12, b), np.arange(12))).sum() == pytest.approx(1, abs=1e-5)
    # The class of others is shared out by counts: its words seen, and one half for those never seen.
    rare = [c for _, c in counts.known[10:]] + [1] * (45 - 1 - 30)
    assert model.other_total == pytest.approx(seen[1] + 0.5 * len(rare) + 0.5)


def test_contexts_end_with_their_texts():
    ids = np.array([5, 6, 7, 0, 0, 8, 0])  # three texts: 5 6 7, none, 8
    a, b = language_model.contexts(ids, np.array([3, 4, 6]))
    assert b.tolist() == [0, 5, 6, 7, 0, 0, 8] and a.tolist() == [0, 0, 5, 6, 0, 0, 0]


def test_steps_follow_the_gradient():
    """One batch against differences of the noise-contrastive loss."""
    counts = language_model.Counts([(b"x", 9), (b"y", 5), (b"z", 2)], 20, 4, 4, None)
    model, seen = language_model.started(counts, vocabulary=5, size=3)
    rng = np.random.default_rng(1)
    a, b, w = (rng.integers(0, 5, 30) for _ in range(3))
    trainer = language_model.Trainer(model, seen, 9, step=1e-3)
    drawn = np.minimum(np.searchsorted(trainer.cumulated, np.random.default_rng(9).random(language_model.DRAWN)), 4)

    def loss(out, left, before, bias):
        h = left[b] + before[a]
        own = (h * out[w]).sum(1) + bias[w] - trainer.noise_logs[w]
        other = h @ out[drawn].T + bias[drawn] - trainer.noise_logs[drawn]
        return np.log1p(np.exp(-own)).sum() + language_model.NOISE / language_model.DRAWN * np.log1p(np.exp(other)).sum()

    p = [np.array(x, float) for x in (model.out, model.left, model.before, model.bias)]
    trainer.batch(a, b, w)
    for k, (before, after) in enumerate(zip(p, trainer.p, strict=True)):
        moved = after.reshape(before.shape) - before
        at = tuple(np.unravel_index(np.abs(moved).argmax(), moved.shape))
        q = [x.copy() for x in p]
        q[k][at] += 1e-5
        slope = (loss(*q) - loss(*p)) / 1e-5
        g = slope / math.sqrt(30)
        assert moved[at] == pytest.approx(-1e-3 * g / math.sqrt(0.1 + g * g), rel=1e-2)


def test_the_model_learns_what_follows_what(spark, tmp_path):
    data = corpus()
    frame(spark, data).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op13_language_model(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in got if r.held_out} == {d for d, _ in data if d is not None and zlib.crc32(str(d).encode()) % 5 == 1} and len(got) == len(data)
    assert all(r.score < 0 for r in got)
    held = language_model.scored(frame(spark, data[:300]), F.col("doc_id") % 5 != 1, rounds=8).where("doc_id % 5 = 1").collect()
    assert sum(r.lm_score for r in held) > 0.85 * sum(r.lm_base_score for r in held)


def test_models_without_texts(spark):
    def scored(data, train):
        return language_model.scored(frame(spark, data), train).collect()

    assert scored([], F.lit(True)) == []
    none = scored([(1, "a b"), (2, None), (None, "")], F.lit(None).cast("boolean"))
    assert {(r.doc_id, r.lm_tokens, r.lm_known, r.lm_train_tokens) for r in none} == {(1, 3, 0, 0), (2, 1, 0, 0), (None, 1, 0, 0)}
    assert all(math.isfinite(r.lm_score) and r.lm_base_score == 0 for r in none)
    ends = scored([(1, ""), (2, "  ")], F.lit(True))
    assert all(r.lm_known == 1 and math.isfinite(r.lm_score) for r in ends)
    long = scored([(1, "y" * 100 + " " + "z"), (2, "y" * 100), (3, "q")], F.col("doc_id") < 3)
    assert {(r.doc_id, r.lm_known) for r in long} == {(1, 3), (2, 2), (3, 1)}
