"""Fill-in-the-middle texts: each text is cut into units, a middle is taken out and put behind what surrounds it.

The cut is found by two passes of a lazy matcher over the text. The first counts units, the second advances until it has met both
ranks and stops there. Neither keeps a match: besides the text and its output a row takes the same memory whatever its length. What is
drawn for a row depends on its id and the seed alone, so a row that is computed again comes out the same.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.shared import grouped, mapped, without

#: What marks the beginning of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"
#: Lines, each with its end.
LINES = r"[^\n]*\n|[^\n]+"
SEED, RATE, SPM_RATE = 7, 100, 50
ADDED = {"fim_units": T.LongType(), "fim_form": T.StringType(), "fim_prefix_chars": T.LongType(), "fim_middle_chars": T.LongType(), "fim_output": T.StringType()}
RESTORED = {"fim_restored": T.StringType()}


class Drawn(NamedTuple):
    units: int
    form: str
    prefix: int | None
    middle: int | None
    output: str


def drawn_numbers(seed: int, key: object) -> list[int]:
    """Four numbers below 2 ** 32 that seed and key decide; a missing key is written as nothing."""
    digest = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).digest()
    return [int.from_bytes(digest[i : i + 4], "big") for i in range(0, 16, 4)]


def counted(unit: re.Pattern, text: str) -> int:
    """First pass: how many units there are."""
    return sum(1 for _ in unit.finditer(text))


def ends_at(unit: re.Pattern, text: str, first: int, last: int) -> tuple[int, int]:
    """Second pass: where unit number `first` and unit number `last` end, from 1; 0 is the text's beginning."""
    ends, rank = [0, 0], 0
    if last:
        for rank, match in enumerate(unit.finditer(text), 1):
            if rank == first:
                ends[0] = match.end()
            if rank == last:
                ends[1] = match.end()
                break
    return ends[0], ends[1]


def transformed(unit: re.Pattern, key: object, text: str | None, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> Drawn:
    text = text or ""
    n = counted(unit, text)
    h = drawn_numbers(seed, key)
    if not text or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)) or h[2] % 100 >= rate:
        return Drawn(n, PLAIN, None, None, text)
    a, b = ends_at(unit, text, *sorted((h[0] % (n + 1), h[1] % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h[3] % 100 < spm_rate:
        return Drawn(n, SPM, a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}")
    return Drawn(n, PSM, a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}")


def restored(output: str | None, form: str | None) -> str | None:
    """The text that an output was made of. No part of it holds a mark, so each mark stands where it was put; None where the output
    isn't of its form."""
    if output is None or form not in (PSM, SPM):
        return output if form == PLAIN else None
    first, second = (PREFIX, SUFFIX) if form == PSM else (SUFFIX, PREFIX)
    at, m = output.find(second), output.find(MIDDLE)
    if not output.startswith(first) or not 0 < at < m:
        return None
    one, two, middle = output[len(first) : at], output[at + len(second) : m], output[m + len(MIDDLE) :]
    return one + middle + two if form == PSM else two + middle + one


def filled(df: DataFrame, key: str = "doc_id", text: str = "text", unit: str = LINES, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, keep_text: bool = True) -> DataFrame:
    """df with fim_units, fim_form (plain, psm or spm), fim_prefix_chars and fim_middle_chars (null if plain) and fim_output.

    unit: a pattern whose matches, none of them empty, lie one behind another and cover the text. rate: of a hundred texts so many are
    cut; spm_rate: of a hundred cut ones so many begin with their suffix. A row out for each row in. Null and empty texts are plain and
    empty; a text that holds a mark is plain; rows without a key draw as if it were empty, and equal rows draw alike. Columns of those
    names are replaced, and key and text may have any names, these too. keep_text: whether the text itself comes out.
    """
    names, at, of = _plan(df if keep_text else df.drop(text), ADDED)
    source = df.select(*(df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)), df[f"`{key}`"].cast("string").alias("key"), df[f"`{text}`"].alias("text"))
    kept = [df.schema[c] for c in names]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern = re.compile(unit)
        for batch in batches:
            for part in grouped(batch, at):
                rows = [transformed(pattern, k, t, seed, rate, spm_rate) for k, t in zip(part.column(of).to_pylist(), part.column(at).to_pylist(), strict=True)]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                new = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *new], names=[*names, *ADDED])

    return mapped(source, run, T.StructType([*kept, *(T.StructField(k, v) for k, v in ADDED.items())]))


def unfilled(df: DataFrame, output: str = "fim_output", form: str = "fim_form") -> DataFrame:
    """df with fim_restored, rebuilt from output and form; null where the output isn't of its form. A row out for each row in."""
    names, at, of = _plan(df, RESTORED)
    source = df.select(*(df[f"`{c}`"].alias(f"c{i}") for i, c in enumerate(names)), df[f"`{form}`"].alias("key"), df[f"`{output}`"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in grouped(batch, at):
                new = pa.array([restored(o, f) for f, o in zip(part.column(of).to_pylist(), part.column(at).to_pylist(), strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], new], names=[*names, *RESTORED])

    return mapped(source, run, T.StructType([*(df.schema[c] for c in names), *(T.StructField(k, v) for k, v in RESTORED.items())]))


def _plan(df: DataFrame, added) -> tuple[list[str], int, int]:
    """The columns that stay, and where text and key stand behind them."""
    names = without(df, added).columns
    return names, len(names) + 1, len(names)


#: DuckDB: the same with whole lists of lines.
SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS lines, [CAST('0x' || substr(h, 1 + 8 * i, 8) AS BIGINT) FOR i IN range(4)] AS r FROM d),
c AS (SELECT *, CAST(len(lines) AS BIGINT) AS n, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR r[3] % 100 >= 100 AS plain FROM u),
k AS (SELECT *, least(r[1] % (n + 1), r[2] % (n + 1)) AS a, greatest(r[1] % (n + 1), r[2] % (n + 1)) AS b FROM c),
p AS (SELECT *, coalesce(array_to_string(lines[1:a], ''), '') AS prefix, coalesce(array_to_string(lines[a + 1:b], ''), '') AS middle, coalesce(array_to_string(lines[b + 1:], ''), '') AS suffix FROM k),
o AS (SELECT *, CASE WHEN plain THEN 'plain' WHEN r[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM p)
SELECT doc_id, n, form, CASE WHEN NOT plain THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN NOT plain THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(t) AS restored_sha256 FROM o
"""
