"""Token ids in files: range-coded blocks in order of the documents, and reading them back.

A table of files in the shared folder holds a row per segment: the documents of
a stretch of the order, their lengths, and the blocks of their ids, each of
which is coded by itself, under the model in front of the first, and has a checksum. A segment ends with the document
that brings it to SEGMENT ids, so a reader needs one segment at a time. Spark
writes and reads the files, so they can lie in any store and a lost task is
simply run again.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import groupby
from uuid import uuid4

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers.pre_tokenizers import ByteLevel

from courant.llm import rangecoder
from courant.llm.bpe import byte_pieces, byte_signs, encoded, keys_of, spaced_once, tokenizer, word_of
from courant.session import shared_folder

SEGMENT, BYTES = 1 << 22, 8 << 20
_BLOCKS = "array<struct<n: int, crc: long, data: binary>>"
_SEGMENT = f"part int, segment int, doc_ids array<long>, lengths array<long>, total long, blocks {_BLOCKS}"


_LETTERS, _MARKS = "[A-Za-zÀ-ÖØ-öø-ɏ]+", r"[!-&(-/:;=?@\[-`{}~]"
_PIECE = re.compile(rf"{_LETTERS}|{_MARKS}+|\n")
_PLAIN = re.compile(rf"({_LETTERS})({_MARKS}*)((?:\n{_LETTERS}{_MARKS}*)*)")


class _Words:
    """Ids by word key for one Python process; words not met for long are forgotten."""

    LIMIT, LONGEST, TOGETHER = 500_000, 64, 1000

    def __init__(self, path: str):
        self.path, self.met, self.before = path, {}, {}
        self.sizes = np.array([len(p) for p in byte_pieces(path)])
        whole = tokenizer(path)
        self.model, self.signs, split = whole.model, byte_signs(), whole.pre_tokenizer
        # Whether letters, marks and line ends are split as _PIECE does.
        self.splits = (
            whole.normalizer is None and isinstance(split, ByteLevel) and split.use_regex
            and not split.add_prefix_space
            and all(_PIECE.sub("", t.content) for t in whole.get_added_tokens_decoder().values())
        )

    def piece(self, signs: str) -> bytes:
        """Ids of what the tokenizer does not split."""
        return array("I", [t.id for t in self.model.tokenize(signs)]).tobytes()

    def known(self, key: str) -> bytes:
        """Ids of a word that the tokenizer does not split, which is kept."""
        ids = self.met.get(key) or self.before.get(key)
        if ids is None:
            ids = self.piece(word_of(key).encode().decode("latin-1").translate(self.signs))
            if len(key) <= self.LONGEST:
                self.met[key] = ids
        return ids

    def learn(self, keys: list[str]) -> list[bytes]:
        """Ids of words that are not known, as little-endian unsigned 32-bit integers.

        Words of letters and common marks are put together from their pieces. Others
        that begin and end with visible signs are encoded as one text, as no token
        crosses the spaces between them, and told apart by the bytes of the ids.
        """
        found = dict.fromkeys(keys)
        if self.splits:
            space = self.signs[32]
            for k in found:
                if k.isascii() and k.isalpha():
                    found[k] = self.piece(space + k)
                elif plain := _PLAIN.fullmatch(k):
                    first, marks, lines = plain.groups()
                    ids = self.known(first)
                    if marks:
                        ids += self.known(" " + marks)
                    if lines:
                        ids += b"".join([self.known(" " + x) for x in _PIECE.findall(lines)])
                    found[k] = ids
        joined = [k for k, ids in found.items() if ids is None and k and not k[0].isspace() and not k[-1].isspace()]
        for at in range(0, len(joined), self.TOGETHER):
            some = joined[at : at + self.TOGETHER]
            raw = encoded(self.path, [" ".join(some)])[0]
            ends = np.cumsum(self.sizes[np.frombuffer(raw, "<u4")])
            want = np.cumsum([1 + len(k.encode()) for k in some])
            cuts = np.searchsorted(ends, want)
            if ends[-1] == want[-1] and (ends[cuts] == want).all():
                cuts = [0, *((cuts + 1) * 4).tolist()]
                found.update(zip(some, (raw[a:b] for a, b in zip(cuts, cuts[1:]))))
        rest = [k for k, ids in found.items() if ids is None]
        found.update(zip(rest, encoded(self.path, rest)))
        return [found[k] for k in keys]

    def look_up(self, keys: list[str]) -> list[bytes]:
        ids = list(map(self.met.get, keys))
        lost = [i for i, x in enumerate(ids) if x is None]
        own = [keys[i] for i in lost]
        older = list(map(self.before.get, own))
        new = [i for i, x in enumerate(older) if x is None]
        for i, x in zip(new, self.learn([own[i] for i in new])):
            older[i] = x
        for i, key, x in zip(lost, own, older):
            ids[i] = x
            if len(key) <= self.LONGEST and "\n" not in key:  # whose pieces are kept
                self.met[key] = x
        if len(self.met) > self.LIMIT:
            self.met, self.before = {}, self.met
        return ids

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in a row, and how many each text has."""
        runs, counts, at = [], [], 0
        for plain, run in groupby(texts.to_pylist(), spaced_once):
            run = list(run)
            if plain:
                split = pc.split_pattern(texts.slice(at, len(run)), " ")
                runs.append(split.flatten())
                counts.extend(pc.list_value_length(split).to_pylist())
            else:
                split = [keys_of(t) for t in run]
                runs.append(pa.array([k for s in split for k in (s[0][1:], *s[1:])], texts.type))
                counts.extend(map(len, split))
            at += len(run)
        words = pa.concat_arrays(runs)
        starts = np.cumsum([0, *counts[:-1]])
        table = words.dictionary_encode()
        number = table.indices.to_numpy().copy()
        keys = table.dictionary.to_numpy(zero_copy_only=False).tolist()
        number[starts] = len(keys) + np.arange(len(starts))  # the first word of a text has no space before it
        known = self.look_up(keys + [" " + w for w in words.take(pa.array(starts)).to_pylist()])
        flat, sizes = np.frombuffer(b"".join(known), "<u4"), np.array([len(x) // 4 for x in known])
        each = sizes[number]
        shift = (np.cumsum(sizes) - sizes)[number] - (np.cumsum(each) - each)
        ids = flat[np.arange(each.sum()) + np.repeat(shift, each)]
        return ids, np.add.reduceat(each, starts)


@lru_cache(maxsize=1)
def _words(path: str) -> _Words:
    """The words that this process knows, also from earlier tasks."""
    return _Words(path)


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of about BYTES of text; a longer text ends its batch."""
    held, size = [], 0
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(), dtype=np.int64)
        done = 0
        while done < batch.num_rows:
            before = int(sizes[done - 1]) if done else 0
            stop = min(int(np.searchsorted(sizes, before + BYTES - size)) + 1, batch.num_rows)
            held.append(batch.slice(done, stop - done))
            size, done = size + int(sizes[stop - 1]) - before, stop
            if size >= BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
    if held:
        yield pa.concat_batches(held)


def coded(ids: np.ndarray) -> list[dict]:
    """Blocks of a stretch of ids."""
    if len(ids) and int(ids.max()) >= 1 << 16:
        raise ValueError("ids must be below 65536")
    blocks = [ids[i : i + rangecoder.BLOCK] for i in range(0, len(ids), rangecoder.BLOCK)]
    return [{"n": n, "crc": crc, "data": data} for n, crc, data in rangecoder.encode(blocks)]


def _segments(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, docs, ids, lengths, held, segment, part = _words(path), [], [], [], 0, 0, 0

        def out() -> pa.RecordBatch:
            row = {
                "part": part, "segment": segment, "doc_ids": docs, "lengths": np.concatenate(lengths),
                "total": held, "blocks": coded(np.concatenate(ids)),
            }
            kind = pa.struct([("n", pa.int32()), ("crc", pa.int64()), ("data", pa.binary())])
            types = [pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int64(), pa.list_(kind)]
            return pa.RecordBatch.from_arrays(
                [pa.array([v], t) for v, t in zip(row.values(), types)], list(row)
            )

        for some in _stretches(batches):
            part = some.column(2)[0].as_py()
            flat, sizes = words.of(pc.fill_null(some.column(1), ""))
            flat = np.insert(flat, np.cumsum(sizes), end_id)
            names, sizes = some.column(0).to_pylist(), sizes + 1
            ends, done = np.cumsum(sizes), 0
            while done < len(names):
                first = int(ends[done] - sizes[done])
                stop = min(int(np.searchsorted(ends, first + SEGMENT - held)) + 1, len(names))
                docs.extend(names[done:stop])
                ids.append(flat[first : ends[stop - 1]])
                lengths.append(sizes[done:stop])
                held, done = held + len(ids[-1]), stop
                if held >= SEGMENT:
                    yield out()
                    docs, ids, lengths, held, segment = [], [], [], 0, segment + 1
        if docs:
            yield out()

    return run


def write_tokens(
    docs: DataFrame, path: str, end_id: int, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> str:
    """Write the ids of all texts in ascending order of the ids of documents; returns the folder.

    `path` is a tokenizer file with ids below 65536; `end_id` follows each
    document. Null and empty texts have only that. Null ids come first; rows with
    the same id are ordered by a hash of the text. Other columns are not looked at.
    """
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark).rstrip('/')}/tokens-{uuid4().hex}"
    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"),
    ).withColumn("mark", F.xxhash64("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartitionByRange(parts, F.col("doc_id").asc_nulls_first(), "mark").sortWithinPartitions(
        F.col("doc_id").asc_nulls_first(), "mark"
    )
    numbered = ordered.select("doc_id", "text", F.spark_partition_id().alias("part"))
    numbered.mapInArrow(_segments(path, end_id), _SEGMENT).write.parquet(folder)
    return folder


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            blocks = rangecoder.decode([(b["n"], b["crc"], b["data"]) for b in row["blocks"]])
            flat = np.concatenate(blocks) if blocks else np.empty(0, "<u4")
            raw, ends = memoryview(flat).cast("B"), np.cumsum([0, *row["lengths"]])
            for at in range(0, len(row["doc_ids"]), 1000):
                some = ends[at : min(at + 1000, len(row["doc_ids"])) + 1]
                own, cuts = flat[some[0] : some[-1]].astype(np.int32), (some * 4).tolist()
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(row["doc_ids"][at : at + 1000], pa.int64()),
                        pa.array((row["before"] + some[:-1]).astype(np.int64)),
                        pa.ListArray.from_arrays(pa.array((some - some[0]).astype(np.int32)), pa.array(own)),
                        pa.array([zlib.crc32(raw[a:b]) for a, b in zip(cuts, cuts[1:])], pa.int64()),
                    ],
                    ["doc_id", "start", "ids", "ids_crc32"],
                )


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids, ids_crc32) of every document, checked against the blocks' checksums.

    `start` counts the ids of all documents before it. Damaged blocks are an error.
    """
    schema = _SEGMENT
    segments = spark.read.schema(schema).parquet(folder)
    # One number per segment, so the order of all of them is a small table.
    totals = segments.select("part", "segment", "total")
    order = Window.orderBy("part", "segment").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("part", "segment", F.coalesce(F.sum("total").over(order), F.lit(0)).alias("before"))
    rows = segments.join(before, ["part", "segment"]).select("before", "doc_ids", "lengths", "blocks")
    return rows.mapInArrow(_documents, "doc_id long, start long, ids array<int>, ids_crc32 long")
