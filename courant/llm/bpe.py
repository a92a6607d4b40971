"""BPE encoding and decoding of whole texts with a table of distinct words.

A word is a stretch of text between single spaces that have no white space next
to them; the space belongs to the word after it. No pre-token of a byte-level
tokenizer crosses such a border, so the ids of a text are those of its words in
a row. Texts are split in parts of about PART_CHARS characters: a part becomes
the numbers of its words in order, and its distinct words, dealt into buckets
by a hash. A distinct word of the corpus lies in one bucket and is encoded
there once; its ids are joined back to the part, where numbers become ids.
Decoding looks every id up in the id-to-piece table, whose size is the
vocabulary's.

A word is keyed by its text after the space; the first word of a text has no
space before it and is keyed with one in front.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from uuid import uuid4

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from courant.llm.common import bucketed

PART_CHARS = 16_000_000
_KNOWN = 300_000  # words whose ids a task keeps
_WHITE = [c for c in map(chr, range(0x3001)) if c.isspace()]
_BORDER = re.compile(r"(?<=\S) (?=\S)")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """The tokenizer of a file, without truncation and padding."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the tasks are the parallel part
    loaded = Tokenizer.from_file(path)
    loaded.no_truncation()
    loaded.no_padding()
    return loaded


def spaced_once(text: str) -> bool:
    """Whether every space of a text is a border of words."""
    return "  " not in text and text[:1] != " " and text[-1:] != " " and not any(
        c in text and (c + " " in text or " " + c in text) for c in _WHITE if c != " "
    )


def keys_of(text: str) -> list[str]:
    """Word keys of a text, in order."""
    words = text.split(" ") if spaced_once(text) else _BORDER.split(text)
    words[0] = " " + words[0]
    return words


def word_of(key: str) -> str:
    return key[1:] if key[:1] == " " else " " + key


def encoded(path: str, keys: list[str]) -> list[bytes]:
    """Ids of each word, as little-endian unsigned 32-bit integers."""
    rows = tokenizer(path).encode_batch_fast([word_of(k) for k in keys], add_special_tokens=False)
    return [np.array(r.ids, "<u4").tobytes() for r in rows]


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch.column(1).to_pylist()]


class _Numbers(dict):
    """Numbers words as they come."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


_STEP = 1 << 16  # integers unpacked at a time


def _pack(values: np.ndarray) -> bytes:
    """Small integers: the bit length of each plus one, compressed, then its lower bits by length."""
    plain = values.astype(np.uint32) + np.uint32(1)
    length = (np.frexp(plain.astype(np.float64))[1] - 1).astype(np.uint8)
    head = zstandard.ZstdCompressor(level=3).compress(length.tobytes())
    out = [len(head).to_bytes(4, "little"), head]
    for n in range(1, 32):
        own = plain[length == n]
        for at in range(0, len(own), _STEP):
            bits = np.unpackbits(own[at : at + _STEP].astype(">u4").view(np.uint8).reshape(-1, 4), axis=1)
            out.append(np.packbits(bits[:, 32 - n :]).tobytes())
    return b"".join(out)


def _unpack(data: bytes) -> np.ndarray:
    at = 4 + int.from_bytes(data[:4], "little")
    length = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[4:at]), np.uint8)
    plain = np.ones(len(length), np.uint32)
    for n in range(1, 32):
        every = np.flatnonzero(length == n)
        for start in range(0, len(every), _STEP):
            own = every[start : start + _STEP]
            size = -(-len(own) * n // 8)
            packed = np.frombuffer(data, np.uint8, size, at)
            bits = np.zeros((len(own), 32), np.uint8)
            bits[:, 31 - n] = 1
            bits[:, 32 - n :] = np.unpackbits(packed)[: len(own) * n].reshape(-1, n)
            plain[own] = np.packbits(bits, axis=1).view(">u4").ravel()
            at += size
    return plain - np.uint32(1)


_PARTS = "part string, bucket int, sizes binary, data binary, ids array<long>, also array<long>, lengths array<int>"
_PART_TYPES = [
    pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()),
]


def _split(buckets: int):
    """Rows of each part: without a bucket its numbers, with one the distinct words of the bucket."""

    def part(numbers: _Numbers, rows: list[np.ndarray], ids: list, also: list) -> pa.RecordBatch:
        name, flat = uuid4().hex, np.concatenate(rows)
        order = np.argsort(-np.bincount(flat, minlength=len(numbers)), kind="stable")  # small numbers for common words
        place = np.empty(len(order), np.uint32)
        place[order] = np.arange(len(order), dtype=np.uint32)
        words = list(numbers)
        raw = [words[i].encode() for i in order]
        bucket = np.fromiter((xxhash.xxh32_intdigest(w) % buckets for w in raw), np.int64, len(raw))
        out = [(name, None, _pack(bucket), _pack(place[flat]), ids, also, [len(r) for r in rows])]
        for b in np.unique(bucket).tolist():
            own = [raw[i] for i in np.flatnonzero(bucket == b)]
            data = zstandard.ZstdCompressor(level=1).compress(b"".join(own))
            out.append((name, b, _pack(np.array([len(w) for w in own])), data, None, None, None))
        names = [c.split()[0] for c in _PARTS.split(", ")]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), _PART_TYPES)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        numbers, rows, ids, also, chars = _Numbers(), [], [], [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                some = batch.slice(at, 100)
                for doc, other, text in zip(some.column(0).to_pylist(), some.column(2).to_pylist(), _texts(some)):
                    also.append(other)
                    rows.append(np.fromiter(map(numbers.__getitem__, keys_of(text)), np.uint32))
                    ids.append(doc)
                    chars += len(text)
                    if chars >= PART_CHARS:
                        yield part(numbers, rows, ids, also)
                        numbers, rows, ids, also, chars = _Numbers(), [], [], [], 0
        if rows:
            yield part(numbers, rows, ids, also)

    return run


def _encode(path: str):
    """(part, bucket, sizes, data): how many ids each word of the row has, and the ids of all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, bytes] = {}
        for batch in batches:
            for row in batch.to_pylist():
                data = zstandard.ZstdDecompressor().decompress(row["data"])
                ends = np.cumsum([0, *_unpack(row["sizes"]).tolist()]).tolist()
                words = [data[a:b] for a, b in zip(ends, ends[1:])]
                new = [w for w in words if w not in known]
                known.update(zip(new, encoded(path, [w.decode() for w in new])))
                ids = [known[w] for w in words]
                if len(known) > _KNOWN:
                    known.clear()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([row["part"]]), pa.array([row["bucket"]], pa.int32()),
                        pa.array([_pack(np.array([len(i) // 4 for i in ids]))], pa.binary()),
                        pa.array([_pack(np.frombuffer(b"".join(ids), "<u4"))], pa.binary()),
                    ],
                    ["part", "bucket", "sizes", "data"],
                )

    return run


def _joined(part: pa.Table, words: pa.Table) -> pa.Table:
    """The ids of every text of a part."""
    row = part.to_pylist()[0]
    bucket, numbers = _unpack(row["sizes"]), _unpack(row["data"])
    pieces = np.empty(len(bucket), object)
    for found in words.to_pylist():
        raw = _unpack(found["data"]).tobytes()
        ends = (np.cumsum([0, *_unpack(found["sizes"]).tolist()]) * 4).tolist()
        pieces[bucket == found["bucket"]] = np.array([raw[a:b] for a, b in zip(ends, ends[1:])] + [b""], object)[:-1]
    ends = np.cumsum([0, *row["lengths"]])
    rows = [b"".join(pieces[numbers[a:b]].tolist()) for a, b in zip(ends, ends[1:])]
    starts = np.cumsum([0, *[len(r) // 4 for r in rows]]).astype(np.int32)
    flat = np.frombuffer(b"".join(rows), "<i4")
    ids = pa.ListArray.from_arrays(pa.array(starts), pa.array(flat))
    return pa.table({"doc_id": pa.array(row["ids"], pa.int64()), "also": pa.array(row["also"], pa.int64()), "ids": ids})


def encode(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", also_col: str | None = None
) -> DataFrame:
    """(doc_id, ids array<int>), one row per input row: the ids of each whole text.

    With `also_col`, a whole number, the rows have it as a column of that name.

    They are what the tokenizer file gives for the text without added special
    tokens. Null and empty texts have no ids. Ids of rows may be null or repeat.
    Other columns of `docs` are not looked at.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    also = F.lit(None) if also_col is None else F.col(also_col)
    texts = docs.select(
        F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), also.cast("long").alias("also")
    )
    parts = bucketed(texts.mapInArrow(_split(buckets), _PARTS), "words", "part", buckets)
    words = (
        parts.where("bucket IS NOT NULL").select("part", "bucket", "sizes", "data").repartition(buckets, "bucket")
        .mapInArrow(_encode(path), "part string, bucket int, sizes binary, data binary")
    )
    numbers = parts.where("bucket IS NULL").drop("bucket")
    done = numbers.groupBy("part").cogroup(words.groupBy("part")).applyInArrow(
        _joined, "doc_id long, also long, ids array<int>"
    )
    return done.drop("also") if also_col is None else done.withColumnRenamed("also", also_col)


def byte_signs() -> dict[int, str]:
    """How a byte-level vocabulary writes each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in plain} | {
        b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in plain)
    }


def byte_pieces(path: str) -> list[bytes]:
    """The bytes of every id of a byte-level vocabulary."""
    byte_of = {sign: b for b, sign in byte_signs().items()}
    vocab = tokenizer(path).get_vocab(with_added_tokens=True)
    pieces = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        known = all(c in byte_of for c in piece)
        pieces[i] = bytes(byte_of[c] for c in piece) if known else piece.encode()
    return pieces


def _decode(path: str, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece = byte_pieces(path).__getitem__
        for batch in batches:
            ids = batch.column(at)
            ends, flat = ids.offsets.to_numpy().tolist(), ids.values.to_numpy()
            texts = [
                b"".join(map(piece, flat[a:b].tolist())).decode("utf-8", "replace") if given else None
                for a, b, given in zip(ends, ends[1:], ids.is_valid().to_pylist())
            ]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "text"])

    return run


def decode(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """`rows` with `text`: what each array of ids stands for, special tokens included; null for null.

    A column of that name is replaced.
    """
    kept = rows.drop("text").withColumn(ids_col, F.col(ids_col).cast("array<int>"))
    schema = T.StructType([*kept.schema.fields, T.StructField("text", T.StringType())])
    return kept.mapInArrow(_decode(path, kept.columns.index(ids_col)), schema)
