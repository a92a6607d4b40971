"""Fill-in-middle: texts cut at two units, the middle moved to the end.

A unit is a run of ASCII letters or any other single code point. A task views
the UTF-8 bytes of a batch of texts as 64-bit words and marks, in the high bit
of each byte, the bytes that end a unit: eight bytes at a time, by arithmetic
that never carries from one byte into the next. `bitwise_count` of the words,
summed, gives how many marks lie before each word; the cut after the k-th unit
is found by a search in those sums and a select inside the one word. The same
words with the first byte of each code point marked turn byte positions into
positions in code points. Pieces are put together by SQL functions.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

U64 = np.uint64
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
COLUMNS = ("n", "form", "prefix_chars", "middle_chars", "output")
#: Words marked at a time: bounds the temporary arrays beside the marks themselves.
BLOCK = 1 << 18

_HIGH, _ONES, _LOW7 = U64(0x8080808080808080), U64(0x0101010101010101), U64(0x7F7F7F7F7F7F7F7F)


def _letters(w: np.ndarray) -> np.ndarray:
    """High bit of each byte that is an ASCII letter."""
    low = (w | U64(0x20) * _ONES) & _LOW7
    from_a = low + U64(0x80 - ord("a")) * _ONES
    past_z = low + U64(0x80 - ord("z") - 1) * _ONES
    return from_a & ~past_z & ~w & _HIGH


def _continued(w: np.ndarray) -> np.ndarray:
    """High bit of each byte that goes on a code point begun before it."""
    return w & ~(w << U64(1)) & _HIGH


class Marks:
    """Marked bytes, in the high bit of each byte of 64-bit words."""

    def __init__(self, words: np.ndarray) -> None:
        self.words = words
        self.before = np.zeros(len(words) + 1, np.int64)
        np.cumsum(np.bitwise_count(words), out=self.before[1:])

    def rank(self, at: np.ndarray) -> np.ndarray:
        """How many marks lie on bytes before each position."""
        word, byte = at >> 3, (at & 7).astype(U64)
        inside = self.words[word] & ((U64(1) << (byte * U64(8))) - U64(1))
        return self.before[word] + np.bitwise_count(inside)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The position of the k-th mark, counted from one."""
        word = np.searchsorted(self.before, k, side="left") - 1
        left = (k - self.before[word]).astype(U64)
        upto = (self.words[word] >> U64(7)) * _ONES  # each byte: marks up to it, in the word
        reached = ((upto | _HIGH) - left * _ONES) & _HIGH
        return (word << 3) + 8 - np.bitwise_count(reached)


def marks(raw: np.ndarray, ends: np.ndarray) -> tuple[Marks, Marks]:
    """Unit ends and code point starts of texts that lie one after the other in `raw`.

    `ends` holds the position after each text; no unit reaches over it.
    """
    padded = np.zeros((len(raw) + 15) // 8 * 8, np.uint8)  # at least one byte past the last text
    padded[: len(raw)] = raw
    words = padded.view("<u8")
    unit, point = np.empty_like(words), np.empty_like(words)
    for i in range(0, len(words), BLOCK):
        w = words[i : i + BLOCK + 1]
        letter, goes_on = _letters(w), _continued(w)
        point[i : i + BLOCK] = (~goes_on & _HIGH)[:BLOCK]

        def following(flags: np.ndarray) -> np.ndarray:
            shifted = flags >> U64(8)
            shifted[:-1] |= flags[1:] << U64(56)
            return shifted[:BLOCK]

        unit[i : i + BLOCK] = _HIGH & ~following(goes_on) & ~(letter[:BLOCK] & following(letter))
    used = np.zeros(len(padded), bool)
    used[: len(raw)] = True
    unit &= _flags(used)
    last = np.zeros(len(padded), bool)
    last[ends[ends > 0] - 1] = True
    unit |= _flags(last)
    return Marks(unit), Marks(point)


def _flags(which: np.ndarray) -> np.ndarray:
    return (which.view(np.uint8) << np.uint8(7)).view("<u8")


def cuts(texts: pa.Array, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of each text, and the code points before the smaller and the larger cut.

    A cut falls after `first % (n + 1)` or `second % (n + 1)` units.
    """
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    offsets -= offsets[0]
    start, end = offsets[:-1], offsets[1:]
    unit, point = marks(raw, end)
    base = unit.rank(start)
    n = unit.rank(end) - base
    sides = []
    for k in (np.minimum(first % (n + 1), second % (n + 1)), np.maximum(first % (n + 1), second % (n + 1))):
        at = start.copy()
        inner = k > 0
        at[inner] = unit.select((base + k)[inner]) + 1
        sides.append(point.rank(at) - point.rank(start))
    return n, *sides


@F.arrow_udf(T.StructType([T.StructField(c, T.LongType()) for c in "nab"]))
def _cut(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
    if not len(texts):
        return pa.array([], pa.struct([(c, pa.int64()) for c in "nab"]))
    found = cuts(texts, first.to_numpy(zero_copy_only=False), second.to_numpy(zero_copy_only=False))
    return pa.StructArray.from_arrays([pa.array(f, pa.int64()) for f in found], ["n", "a", "b"])


def _number(digest: Column, group: int) -> Column:
    """The group-th eight hexadecimal digits, from one, as a number."""
    return F.conv(F.substring(digest, 8 * group - 7, 8), 16, 10).cast("long")


def fill_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salt: str = "1:",
    formed_percent: int = 90, spm_percent: int = 20,
) -> DataFrame:
    """Rows of `docs` with `n` units, `form`, `prefix_chars`, `middle_chars` and the `output` text.

    Cuts and form follow from the SHA-256 of `salt` and the id: `formed_percent`
    of the texts are cut, `spm_percent` of those with the suffix in front; the
    others stay plain, with null lengths, as do empty texts and texts that hold
    one of the three marks. A null text counts as empty and a null id as empty
    text after the salt. Rows are independent: equal rows come out equal, an
    empty table empty, a text of any length is cut as a whole. Columns of `docs`
    that have a name of an added one are replaced by it; all others stay.
    """
    taken = {c.lower() for c in COLUMNS}
    kept = [F.col(f"d.`{c}`") for c in docs.columns if c.lower() not in taken]
    text = F.coalesce(F.col(f"d.`{text_col}`").cast("string"), F.lit(""))
    digest = F.sha2(F.concat(F.lit(salt), F.coalesce(F.col(f"d.`{id_col}`").cast("string"), F.lit(""))), 256)
    rows = docs.select(F.struct("*").alias("d")).select("d", text.alias("t"), digest.alias("h"))
    rows = rows.select("d", "t", "h", _cut("t", _number(F.col("h"), 1), _number(F.col("h"), 2)).alias("c"))
    marked = F.lit(False)
    for mark in (PREFIX, SUFFIX, MIDDLE):
        marked |= F.contains("t", F.lit(mark))
    plain = (F.col("t") == "") | marked | (_number(F.col("h"), 3) % 100 >= formed_percent)
    form = F.when(plain, "plain").when(_number(F.col("h"), 4) % 100 < spm_percent, "spm").otherwise("psm")
    rows = rows.select("d", "t", "c.*", form.alias("form"))
    prefix, middle, suffix = (
        F.expr("substring(t, 1, int(a))"), F.expr("substring(t, int(a) + 1, int(b - a))"), F.expr("substring(t, int(b) + 1)")
    )
    cut = F.col("form") != "plain"
    output = (
        F.when(~cut, F.col("t"))
        .when(F.col("form") == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    return rows.select(
        *kept, "n", "form", F.when(cut, F.col("a")).alias("prefix_chars"),
        F.when(cut, F.col("b") - F.col("a")).alias("middle_chars"), output.alias("output"),
    )


def restored(form: Column, output: Column) -> Column:
    """The text an output was made of. No piece holds a mark, so the first of each kind is the divider."""

    def between(after: str, before: str | None) -> Column:
        start = F.instr(output, after) + len(after)
        if before is None:
            return F.substring(output, start, F.length(output))
        return F.substring(output, start, F.instr(output, before) - start)

    middle = between(MIDDLE, None)
    psm = F.concat(between(PREFIX, SUFFIX), middle, between(SUFFIX, MIDDLE))
    spm = F.concat(between(PREFIX, MIDDLE), middle, between(SUFFIX, PREFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)
