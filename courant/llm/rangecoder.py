"""A range coder for ids below 2^16 under a context-mixing model, run over many blocks in step.

The model is learned from the ids of all blocks of a call and stands, compressed,
in front of the first block; with it each block can be read alone. A block is
coded in lanes of LANE ids, each with its own coder and starting without a
context; their sizes stand in front of them. The chance of
an id is a mix of three predictions: its frequency, its frequency after the id
before it, and after the two ids before it, whatever ids these are. Each order's
counts are mixed with the prediction of the order below in the ratio of their
number to PRIOR. The mix of a context is a table of shares of 2^_BITS, which is
written where it saves more than it takes to write; elsewhere the table of the
shorter context has the smaller sum of bits. Ids whose share is below one part are coded as
an escape and then by frequency alone, so every id can be written after any other.
How much weight frequency alone has beside the tables is kept up to date in each
lane after every id: the shares of the tables' escapes are scaled by the escapes met
to those expected.

As an id and its context fix the next context, an entry of a table names the
table for the id after it, and numpy works on one id of every lane at a time.
Whole numbers below 2^53 are exact in doubles, so the coder's state is kept in them.
"""

from __future__ import annotations

import zlib

import numpy as np
import zstandard

BLOCK, LANE, PRIOR, START = 4096, 512, 4.0, 6.0
_BITS, _FINE_BITS, _RARE_BITS = 11, 16, 20
_PARTS, _FINE, _RARE = 1 << _BITS, float(1 << _FINE_BITS), 1 << _RARE_BITS
_WORD, _LEAST, _MOST = 2.0**16, 2.0**32, 2.0**48
_ENTRY_BITS, _TABLE_BITS = 14, 48
#: A table of a pair met less often cannot save more than it takes, as an id takes _BITS + _RARE_BITS at most without it.
_PAIR_LEAST = (_ENTRY_BITS + _TABLE_BITS) // (_BITS + _RARE_BITS) + 1
_STRETCH = 1 << 20


def _shares(mixed: np.ndarray, of: np.ndarray, tables: int) -> tuple[np.ndarray, np.ndarray]:
    """Parts of 2^_BITS for entries with these chances, in order of their tables, and each table's escape, never 0.

    Entries with less than a part are left to the escape.
    """
    listed = mixed * (mixed * _PARTS >= 1.2)
    held = np.bincount(of, listed, tables)
    rest = np.clip(np.ceil((1 - held) * _PARTS), 1, _PARTS)
    listed *= ((_PARTS - rest) / np.where(held > 0, held, 1))[of]
    ends = np.cumsum(listed)
    first = np.flatnonzero(np.diff(of, prepend=-1))
    before = np.zeros(tables)
    before[of[first]] = ends[first] - listed[first]
    ends = np.minimum(ends - before[of] + 1e-4, (_PARTS - rest)[of]).astype(np.int64)
    parts = np.diff(ends, prepend=0)
    parts[first] = ends[first]
    return parts, _PARTS - np.bincount(of, parts, tables).astype(np.int64)


_BITS_OF = np.append(0, _BITS - np.log2(np.arange(1, _PARTS + 1)))


def _counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order and how often each occurs."""
    keys.sort()
    first = np.flatnonzero(np.diff(keys, prepend=-1))
    return keys[first], np.diff(first, append=len(keys))


class _Index:
    """Where distinct keys stand in an array: a hash table with open addresses."""

    STRETCH = 1 << 16  # what is looked up at a time

    def __init__(self, keys: np.ndarray):
        self.keys, bits = keys, max(4, (2 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slots = np.full(1 << bits, -1, np.int32)
        left, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(left):
            free = self.slots.take(at) < 0
            self.slots[at[free]] = left[free]
            lost = self.slots.take(at) != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def places(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each key; -1: none."""
        out = np.full(len(wanted), -1, np.int32)
        if not len(self.keys):
            return out
        for start in range(0, len(wanted), self.STRETCH):
            some = wanted[start : start + self.STRETCH]
            at = self._home(some)
            found = self.slots.take(at)
            open_ = np.flatnonzero((found >= 0) & (self.keys.take(found, mode="clip") != some))
            at = at[open_]
            while len(open_):
                at = (at + 1) & self.mask
                next_ = found[open_] = self.slots.take(at)
                more = (next_ >= 0) & (self.keys.take(next_, mode="clip") != some[open_])
                open_, at = open_[more], at[more]
            out[start : start + self.STRETCH] = found
        return out


def _worth(n: np.ndarray, saved: np.ndarray, parts: np.ndarray, of: np.ndarray, tables: int) -> np.ndarray:
    """Whether each table saves more bits than it takes to write."""
    return np.bincount(of, n * saved - _ENTRY_BITS * (parts > 0), tables) > _TABLE_BITS


def _learn(ids: np.ndarray) -> bytes:
    """The model of these ids, as `_Model` reads it."""
    counts = np.bincount(ids, minlength=1 << 16)
    symbols = np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]
    counts, wide = counts[symbols], len(symbols)
    rank = np.zeros(1 << 16, np.int64)
    rank[symbols] = np.arange(wide)
    seen = rank[ids]

    chance = counts / len(ids)
    rare = -np.log2(chance)
    root, escape = _shares(chance, np.zeros(wide, np.int64), 1)
    root_bits = np.where(root > 0, _BITS_OF[root], _BITS_OF[escape] + rare)

    ones, n = _counted(seen[:-1] << 16 | seen[1:])
    of, to = ones >> 16, ones & 0xFFFF
    chances = (n + PRIOR * chance[to]) / (np.bincount(of, n, wide)[of] + PRIOR)
    parts, escape = _shares(chances, of, wide)
    bits = np.where(parts > 0, _BITS_OF[parts], _BITS_OF[escape][of] + rare[to])
    kept = _worth(n, root_bits[to] - bits, parts, of, wide)
    bits = np.where(kept[of], bits, root_bits[to])
    # Ids that are escaped rather than listed, by frequency; each keeps a part.
    escaped = np.bincount(to, n * (np.where(kept[of], parts, root[to]) == 0), wide).astype(np.int64)
    rare_parts = 1 + escaped * (_RARE - wide) // max(int(escaped.sum()), 1)
    rare_parts[0] += _RARE - rare_parts.sum()
    own = kept[of] & (parts > 0)
    tables = [(np.zeros(np.count_nonzero(root), np.int64), np.flatnonzero(root), root[root > 0])]
    tables.append(((np.cumsum(kept))[of[own]], to[own], parts[own]))

    # Pairs of any ids that occur often enough; what follows them is looked at in stretches of pairs.
    often = np.flatnonzero(n >= _PAIR_LEAST)
    pair = _Index(ones[often]).places(seen[:-2] << 16 | seen[1:-1])
    met = pair >= 0
    twos, n2 = _counted(pair[met].astype(np.int64) << 16 | seen[2:][met])
    del pair, met
    pairs, next_table, at, index = [], 1 + int(kept.sum()), 0, _Index(ones)
    while at < len(twos):
        stop = len(twos)
        if stop - at > _STRETCH:  # up to the end of a pair
            stop = int(np.searchsorted(twos, ((twos[at + _STRETCH] >> 16) + 1) << 16))
        of2, to2 = twos[at:stop] >> 16, twos[at:stop] & 0xFFFF
        first, m = int(of2[0]), n2[at:stop]
        of2 -= first
        size = int(of2[-1]) + 1
        one = index.places(to[often][of2 + first] << 16 | to2)
        mixed = (m + PRIOR * chances[one]) / (np.bincount(of2, m, size)[of2] + PRIOR)
        parts2, escape2 = _shares(mixed, of2, size)
        bits2 = np.where(parts2 > 0, _BITS_OF[parts2], _BITS_OF[escape2][of2] + rare[to2])
        kept2 = _worth(m, bits[one] - bits2, parts2, of2, size)
        own = kept2[of2] & (parts2 > 0)
        tables.append((next_table - 1 + np.cumsum(kept2)[of2[own]], to2[own], parts2[own]))
        pairs.append(often[first + np.flatnonzero(kept2)])
        next_table, at = next_table + int(kept2.sum()), stop
    pairs = np.concatenate([np.empty(0, np.int64), *pairs])
    table, column, share = (np.concatenate(x) for x in zip(*tables))
    arrays = [
        symbols.astype("<u2"), rare_parts.astype("<u4"), np.flatnonzero(kept).astype("<u2"), of[pairs].astype("<u2"),
        to[pairs].astype("<u2"), np.bincount(table, minlength=next_table).astype("<u2"),
        np.diff(column, prepend=0).astype("<u2"), share.astype("<u2"),
    ]
    plain = np.array([len(a) for a in arrays], "<u4").tobytes() + b"".join(a.tobytes() for a in arrays)
    return zstandard.ZstdCompressor(level=3, write_checksum=True).compress(plain)


class _Model:
    """Tables of contexts and what follows each of their entries."""

    def __init__(self, head: bytes):
        plain = zstandard.ZstdDecompressor().decompress(head)
        sizes, at, arrays = np.frombuffer(plain, "<u4", 8), 32, []
        for n, kind in zip(sizes.tolist(), ("<u2", "<u4", *["<u2"] * 6)):
            arrays.append(np.frombuffer(plain, kind, n, at).astype(np.int64))
            at += arrays[-1].size * int(kind[2])
        self.symbols, rare, ones, before, last, lengths, steps, parts = arrays
        self.wide, tables = len(self.symbols), len(lengths)
        self.rare_parts = rare.astype(float)
        self.rare_ends = np.cumsum(rare)
        self.rare_starts = (self.rare_ends - rare).astype(float)
        self.after = np.zeros(self.wide, np.int64)  # the table after an id alone
        self.after[ones] = 1 + np.arange(len(ones))
        self.pairs, self.first_pair = _Index(before << 16 | last), 1 + len(ones)

        # The entries of a table are followed by its escape.
        listed = np.repeat(np.arange(tables), lengths)
        place = np.arange(len(parts)) + listed
        self.escapes = np.cumsum(lengths) + np.arange(tables)
        column = np.cumsum(steps) & 0xFFFF
        shares = np.zeros(len(parts) + tables, np.int64)
        shares[place] = parts
        listed_parts = np.bincount(listed, parts, tables).astype(np.int64)
        shares[self.escapes] = _PARTS - listed_parts
        starts = (np.cumsum(shares) - shares) % _PARTS
        self.keys = np.repeat(np.arange(tables), lengths + 1) * _PARTS + starts
        self.starts, self.ends = starts.astype(float), (starts + shares).astype(float)
        self.listed, self.escape = listed_parts.astype(float), 1 - listed_parts / _PARTS
        self.rank = np.zeros(len(shares), np.int64)
        self.rank[place] = column
        ends_with = np.concatenate([[-1], ones, last])[listed]
        self.next = np.full(len(shares), -1, np.int64)  # -1: an escape, -2: the id before is not known from the table
        self.next[place] = np.where(ends_with >= 0, self.follow(ends_with, column), -2)
        self.named, self.place = listed << 16 | column, np.append(place, 0)

    def follow(self, before: np.ndarray, last: np.ndarray) -> np.ndarray:
        """The table after these two ids; -1 is no id."""
        pair = self.pairs.places(np.where(before >= 0, before << 16 | last, -2))
        return np.where(pair >= 0, self.first_pair + pair, self.after[last])

    def entries(self, table: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """The entry of each id in a table, or the table's escape."""
        found = _Index(self.named).places(table << 16 | ids)
        return np.where(found >= 0, self.place[found], self.escapes[table])


class _Weights:
    """Parts of _FINE that each lane's tables give to their entries; the rest is their escape's."""

    def __init__(self, model: _Model, rows: int):
        self.model, self.expected, self.met = model, np.full(rows, START), np.full(rows, START)

    def cut(self, rows: int) -> None:
        self.expected, self.met = self.expected[:rows].copy(), self.met[:rows].copy()

    def of(self, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(parts for entries, listed parts of the table)."""
        self.share, listed = self.model.escape.take(table), self.model.listed.take(table)
        rest = np.floor(self.share * _FINE * self.met / self.expected)
        return _FINE - np.maximum(np.minimum(rest, _FINE - listed), 1), listed

    def range_of(self, entry, escaped, wide, listed) -> tuple[np.ndarray, np.ndarray]:
        """Where each entry starts and ends."""
        scale = np.maximum(listed, 1)
        start = np.floor(self.model.starts.take(entry) * wide / scale)
        end = np.floor(self.model.ends.take(entry) * wide / scale)
        start[escaped], end[escaped] = wide[escaped], _FINE
        return start, end

    def learn(self, escaped) -> None:
        self.expected += self.share
        self.met[escaped] += 1


class _Lanes:
    """Stretches of at most LANE ids of blocks, longest first."""

    def __init__(self, lengths: list[int]):
        starts = np.cumsum([0, *lengths])
        cut = [(i, a, min(a + LANE, n)) for i, n in enumerate(lengths) for a in range(0, n, LANE)]
        block, first, end = np.array(cut, np.int64).reshape(-1, 3).T
        self.order = np.argsort(first - end, kind="stable")
        self.lengths = (end - first)[self.order]
        self.starts = (starts[block] + first)[self.order]
        self.row = np.argsort(self.order)  # in order of the blocks
        self.ends = np.searchsorted(block, np.arange(len(lengths)), side="right")

    def live(self) -> list[int]:
        """How many lanes have an id at each step."""
        steps = np.arange(self.lengths[0])
        return (len(self.lengths) - np.searchsorted(self.lengths[::-1], steps, side="right")).tolist()

    def of_blocks(self) -> list[list[int]]:
        """The lanes of each block."""
        return [a.tolist() for a in np.split(self.row, self.ends[:-1])]


def encode(blocks: list[np.ndarray]) -> list[tuple[int, int, bytes]]:
    """(ids, checksum, coded bytes) of each block."""
    checks = [zlib.crc32(b.astype("<u4").tobytes()) for b in blocks]
    if not sum(map(len, blocks)):
        return [(0, check, b"") for check in checks]
    flat = np.concatenate(blocks).astype(np.uint16)
    head = _learn(flat)
    model = _Model(head)
    lanes = _Lanes([len(b) for b in blocks])
    rows = len(lanes.order)
    rank = np.zeros(1 << 16, np.int64)
    rank[model.symbols] = np.arange(model.wide)
    flat = rank[flat]

    # The table and the entry of every id; a lane starts without a context.
    table = np.zeros(len(flat), np.int64)
    new = np.zeros(len(flat) + 1, bool)
    new[lanes.starts] = True
    table[1:] = model.follow(np.concatenate([[-1], np.where(new[1:-2], -1, flat[:-2])]), flat[:-1])
    table[new[:-1]] = 0
    entry = model.entries(table, flat)
    shape = (int(lanes.lengths[0]), rows)
    ids, tables, entries = (np.zeros(shape, np.int32) for _ in range(3))
    for i, (a, n) in enumerate(zip(lanes.starts.tolist(), lanes.lengths.tolist())):
        ids[:n, i], tables[:n, i], entries[:n, i] = flat[a : a + n], table[a : a + n], entry[a : a + n]
    del table, entry, flat

    room = 3 * len(ids) + 4  # an id takes at most _FINE_BITS + _RARE_BITS
    words = np.zeros(rows * room, np.int32)
    at = np.arange(rows) * room
    low, size, weights = np.zeros(rows), np.full(rows, _MOST), _Weights(model, rows)
    final = np.zeros(rows)

    def shift(out):
        """Write a word of these lanes; what is carried over is added in the end."""
        settled, place = low[out], at[out]
        word = np.floor(settled * (1 / _LEAST))
        words[place] = word
        at[out] = place + 1
        low[out] = (settled - word * _LEAST) * _WORD
        size[out] *= _WORD

    for step, live in enumerate(lanes.live()):
        if live < len(low):
            final[live : len(low)] = low[live:]
            low, size = low[:live].copy(), size[:live].copy()
            weights.cut(live)
        table, entry = tables[step, :live], entries[step, :live]
        escaped = np.flatnonzero(model.next.take(entry) == -1)
        start, end = weights.range_of(entry, escaped, *weights.of(table))
        size *= 1 / _FINE
        np.floor(size, out=size)
        low += size * start
        size *= end - start
        shift(np.flatnonzero(size < _LEAST))
        weights.learn(escaped)
        if len(escaped):
            value = ids[step].take(escaped)
            part = np.floor(size[escaped] * (1 / _RARE))
            low[escaped] += part * model.rare_starts[value]
            size[escaped] = part * model.rare_parts[value]
            for _ in range(2):
                shift(escaped[size[escaped] < _LEAST])
    final[: len(low)] = low
    for _ in range(3):
        word = np.floor(final * (1 / _LEAST))
        words[at] = word
        at += 1
        final = (final - word * _LEAST) * _WORD
    carry = np.flatnonzero(words >> 16)
    while len(carry):
        words[carry] &= 0xFFFF
        words[carry - 1] += 1
        carry = carry[words[carry - 1] > 0xFFFF] - 1
    words = words.astype("<u2")
    starts, used = np.arange(rows) * room, at - np.arange(rows) * room
    out, front = [], len(head).to_bytes(4, "little") + head
    for block, check, own in zip(blocks, checks, lanes.of_blocks()):
        parts = [words[starts[k] : at[k]].tobytes() for k in own]
        out.append((len(block), check, front + used[own].astype("<u2").tobytes() + b"".join(parts)))
        front = b""
    return out


def decode(coded: list[tuple[int, int, bytes]]) -> list[np.ndarray]:
    """The ids of each block, checked against the checksums; same order as `encode`."""
    lanes = _Lanes([c[0] for c in coded])
    rows = len(lanes.order)
    if not rows:
        return [np.empty(0, "<u4") for _ in coded]
    front = 4 + int.from_bytes(coded[0][2][:4], "little")
    model = _Model(coded[0][2][4:front])
    room = 3 * int(lanes.lengths[0]) + 8
    words = np.zeros((rows, room), np.uint16)
    for (_, _, data), own in zip(coded, lanes.of_blocks()):
        plain = np.frombuffer(data, "<u2", (len(data) - front) // 2, front)
        ends = len(own) + np.cumsum(plain[: len(own)].astype(np.int64))
        for k, end, n in zip(own, ends.tolist(), plain[: len(own)].tolist()):
            words[k, :n] = plain[end - n : end]
        front = 0
    code = (words[:, 0] * _WORD + words[:, 1]) * _WORD + words[:, 2]
    words, at = words.ravel(), np.arange(rows) * room + 3
    size, context, weights = np.full(rows, _MOST), np.zeros(rows, np.int64), _Weights(model, rows)
    found, last = np.zeros((int(lanes.lengths[0]), rows), np.uint16), np.full(rows, -1)

    def shift(out):
        place = at[out]
        code[out] = code[out] * _WORD + words.take(place, mode="clip")
        at[out] = place + 1
        size[out] *= _WORD

    for step, live in enumerate(lanes.live()):
        if live < len(code):
            code, size, context, last = code[:live].copy(), size[:live].copy(), context[:live].copy(), last[:live]
            weights.cut(live)
        wide, listed = weights.of(context)
        size *= 1 / _FINE
        np.floor(size, out=size)
        want = np.floor(code / size)
        part = np.where(want >= wide, listed, np.floor(((want + 1) * listed - 1) / np.maximum(wide, 1)))
        entry = np.searchsorted(model.keys, context * _PARTS + part.astype(np.int64), side="right") - 1
        context, value = model.next.take(entry), model.rank.take(entry)
        escaped = np.flatnonzero(context == -1)
        start, end = weights.range_of(entry, escaped, wide, listed)
        code -= size * start
        size *= end - start
        shift(np.flatnonzero(size < _LEAST))
        weights.learn(escaped)
        if len(escaped):
            part = np.floor(size[escaped] * (1 / _RARE))
            want = np.minimum((code[escaped] / part).astype(np.int64), _RARE - 1)
            own = np.searchsorted(model.rare_ends, want, side="right")
            code[escaped] -= part * model.rare_starts[own]
            size[escaped] = part * model.rare_parts[own]
            value[escaped] = own
            for _ in range(2):
                shift(escaped[size[escaped] < _LEAST])
        new = np.flatnonzero(context < 0)
        if len(new):
            context[new] = model.follow(last[new], value[new])
        last, found[step, :live] = value, model.symbols.take(value)
    found, out = np.ascontiguousarray(found.T), []
    for i, ((length, check, _), own) in enumerate(zip(coded, lanes.of_blocks())):
        block = found[own].ravel()[:length].astype("<u4")
        if zlib.crc32(block.tobytes()) != check:
            raise ValueError(f"block {i}: the checksum does not match")
        out.append(block)
    return out
