"""Inputs that every operator has to take: nulls, empty and long texts, repeated rows, clashing columns."""

import random

WORDS = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were all her she there would their we him been has when who will no more if out so".split()


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "a", "en", "ing"]) for _ in range(n))


def rows(seed: int = 0):
    """(doc_id, text) with hard cases among ordinary ones."""
    rng = random.Random(seed)
    out = [(i, sentence(rng, rng.randint(1, 60))) for i in range(20)]
    out += [(20, None), (21, ""), (22, "   \n\t "), (None, sentence(rng, 12)), (23, sentence(rng, 20_000)), (24, "x" * 30_000), (25, "Ünïcödé 日本語 😀 \x00 \x85\xa0 z")]
    return [*out, out[3], out[3]]


def frame(spark, data, extra: str = ""):
    """A documents table; extra: names of more columns, all of text."""
    names = extra.split()
    schema = "doc_id bigint, text string" + "".join(f", `{n}` string" for n in names)
    return spark.createDataFrame([(*r, *("kept" for _ in names)) for r in data], schema)
