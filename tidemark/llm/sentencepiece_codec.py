"""SentencePiece encoding and decoding by a table of distinct chunks.

A chunk is a run of whitespace markers with the characters up to the next run. Where no piece of the model holds a
marker after another character, no merge crosses the start of a chunk, so the ids of a text are the ids of its chunks in
order. Each task keeps one table, chunk -> ids: a chunk is segmented when first met, and every text is then a look-up of
its chunks, joined back by position. Texts are decoded from their whole ids, by the library. The table is bounded (`TABLE_ENTRIES`); when full it is begun anew,
which costs time and changes no result. `piece_table_applies` checks the condition on the model, which comes in as bytes
so that executors need no file of their own.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tidemark.llm.shared import aside, grouped, mapped, without

MARK = "▁"
UINT32 = "I" if array("I").itemsize == 4 else "L"
#: Chunks that a task remembers, and characters of text that it handles at a time (one text at least): bounds of its memory.
TABLE_ENTRIES, GROUP_CHARS = 150_000, 500_000
ADDED = {"token_ids": T.BinaryType(), "n_tokens": T.LongType(), "decoded": T.StringType()}


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def processor(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def piece_table_applies(sp) -> bool:
    """True if chunks can be segmented one by one: no piece crosses into a marker, spaces are kept, one is put in front."""
    crossing = any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.get_piece_size()))
    keeps = sp.decode(sp.encode(" a  b ")) == " a  b " and sp.encode("a") == sp.encode_as_ids("a")
    front = sp.id_to_piece(sp.encode("éa  b"))[:1] and "".join(sp.id_to_piece(sp.encode("ab"))).startswith(MARK)
    plain = all(sp.decode(sp.encode(x)) == x for x in ("ﬁ Ａ", "é x", "a\tb\nc"))  # no normalisation
    return bool(not crossing and keeps and front and plain)


def texts_of(sp, packed: list[bytes]) -> list[str]:
    """What the library's decode makes of whole packed ids. Begin and end ids decode to nothing."""
    return sp.decode([array(UINT32, b).tolist() for b in packed], num_threads=1)


class ChunkTable:
    """Distinct chunks, without their first marker, and their packed ids."""

    def __init__(self, model: bytes, entries: int = TABLE_ENTRIES):
        self.sp, self.entries, self.ids = processor(model), entries, {}
        if not piece_table_applies(self.sp):
            raise ValueError("pieces of this model cross whitespace markers or it changes its input: chunks can't be segmented one by one")
        self.find = re.compile(f"{MARK}({MARK}*[^{MARK}]*)").findall
        self.lone = self.sp.piece_to_id(MARK)
        self.begin, self.end = (array(UINT32, [i]).tobytes() for i in (self.sp.bos_id(), self.sp.eos_id()))

    def chunks(self, text: str | None) -> list[str]:
        if not text:
            return []
        if "  " in text or text[0] == " " or MARK in text:
            return self.find(MARK + text.replace(" ", MARK))
        return text.split(" ")  # the same where no two markers meet

    def learn(self, chunks: list[str]) -> None:
        """Segment chunks that the table lacks. The library puts one marker in front of what it encodes: the chunk's first."""
        plain = [c.replace(MARK, " ") for c in chunks]
        found = [ids or [self.lone] for ids in self.sp.encode(plain, num_threads=1)]
        self.ids.update(zip(chunks, [array(UINT32, ids).tobytes() for ids in found], strict=True))

    def encode(self, texts: list[str | None]) -> tuple[list[bytes], list[str]]:
        """For each text its ids with begin and end, as little-endian unsigned 32-bit integers, and what they decode to.
        None is the empty text."""
        chunks = [self.chunks(t) for t in texts]
        distinct = set(chain.from_iterable(chunks))
        if len(self.ids) + len(distinct) > self.entries:
            self.ids.clear()
        self.learn([c for c in distinct if c not in self.ids])
        ids, id_of = [], self.ids.__getitem__
        for c in chunks:
            parts = list(map(id_of, c))
            parts.append(self.end)
            ids.append(self.begin + b"".join(parts))
        return ids, texts_of(self.sp, ids)


def encoded(df: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """df with token_ids (packed, little-endian unsigned 32-bit, begin and end included), n_tokens and decoded.

    One row out for each row in, repeated rows and null ids too; a null text counts as empty; columns of df with the names of
    the added ones are replaced; an empty df gives an empty result. Order of rows isn't kept across partitions.
    """
    names = without(df, ADDED).columns
    schema, at = T.StructType([*(df.schema[c] for c in names), *(T.StructField(k, v) for k, v in ADDED.items())]), len(names)
    source = df.select(*aside(df, names), df[f"`{text}`"].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = ChunkTable(model)
        for batch in batches:
            for part in grouped(batch, at, GROUP_CHARS):
                ids, texts = table.encode(part.column(at).to_pylist())
                more = [pa.array(ids, pa.binary()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(texts, pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[:at], *more], names=[*names, *ADDED])

    return mapped(source, run, schema)


def decoded(df: DataFrame, model: bytes, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """df with the text of packed ids; null ids give a null text, and a column named `out` is replaced. A row out for each row in."""
    names = without(df, [out]).columns
    schema, at = T.StructType([*(df.schema[c] for c in names), T.StructField(out, T.StringType())]), len(names)
    source = df.select(*aside(df, names), df[f"`{ids}`"].alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = processor(model)
        for batch in batches:
            texts = [None if b is None else texts_of(sp, [b])[0] for b in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:at], pa.array(texts, pa.string())], names=[*names, out])

    return mapped(source, run, schema)
