"""Personal data in whole texts, plain and disguised, as spans of the source text.

Plain finds are regular expressions with checks. For disguised ones a text goes
through two transducers that write a normalised text and, for every character
of it, the source span it stands for: one for characters (homoglyphs, full
width and other compatibility forms, digits of other scripts, invisible
characters), one for words (spelled digits, `plus`, and disguises of at and
dot). The same finders run on the normalised text; a find that holds a changed
character is mapped back to the source and added.

Offsets are code points of the text as stored, ends exclusive.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")

# Letters that look like Latin ones and have no compatibility form.
_LOOKALIKES = dict(zip("аеорсухіјѕԁһӏАВЕКМНОРСТХІЅЈαοινρυκΑΒΕΗΙΚΜΝΟΡΤΥΧΖ", "aeopcyxijsdhlABEKMHOPCTXISJaoivpukABEHIKMNOPTYXZ"))
_DIGITS = {w: str(i) for i, w in enumerate("zero one two three four five six seven eight nine".split())}
# Hyphens and dashes that stand for "-" between digits.
_DASHES = "‐‑‒–−"
# Endings of a host name that a bare "at" may lead to.
_ENDINGS = frozenset("com org net edu gov mil int info biz io dev app co uk de fr es nl ch eu ru cn jp kr br ca au".split())
# Words that stand before "at" in prose, so that none of them is taken as a name.
_BEFORE_AT = frozenset(
    "me you him her us them it be is am are was were been being look looks looked looking meet meets met see sees"
    " saw seen stay stays stayed live lives lived work works worked working available found out up down here there"
    " read more online home arrive arrives arrived start starts started aim aims aimed good bad only not and or"
    " stop stops stopped sit sits sat stand stands stood shop shops visit buy sold hosted not".split()
)
_INVISIBLE = dict.fromkeys("­​‌‍⁠﻿", "")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match never starts within a run of digits: what fails at its start fails later in it too.
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_WORD = "|".join(_DIGITS)
_DIGIT = rf"(?:[0-9]+|(?:{_WORD})(?![A-Za-z]))"
# Digits, at least one of them as a word, and dots between: four parts or more, however they are mixed.
_SPELLED = re.compile(
    rf"(?<![A-Za-z0-9])(?:plus[ -])?(?=(?:[0-9]+(?: |-|, ?|\.)|(?:dot|point) ){{0,8}}(?:{_WORD})(?![A-Za-z]))"
    rf"{_DIGIT}(?:(?: |-|, ?|\.)(?:{_DIGIT}|(?:dot|point)(?![A-Za-z]))){{3,}}(?![A-Za-z0-9])", re.I
)
_TOKEN = re.compile(r"[A-Za-z]+|[0-9]+|\.")
_AT = r" ?[\[({<] ?(?:at|@|arroba|arobase) ?[\])}>] ?|&#64;|&commat;|%40"
_DOT = r" ?[\[({<] ?(?:dot|\.|punkt|punto|point) ?[\])}>] ?|&#46;|&period;"
_RULES = re.compile(
    rf"(?P<digits>{_SPELLED.pattern})|(?P<at>{_AT})|(?P<dot>{_DOT})"
    r"|(?P<bare_at>(?<=[A-Za-z0-9]) at (?=[A-Za-z0-9]))|(?P<bare_dot>(?<=[A-Za-z0-9]) dot (?=[A-Za-z0-9]))", re.I
)
_BARE = re.compile(rf"[a-z0-9] at [a-z0-9-]+(?:\.[a-z0-9-]+)*\.(?:{'|'.join(sorted(_ENDINGS))})(?![a-z0-9-])")
_DASHED = re.compile(rf"(?<=[0-9])[{_DASHES}](?=[0-9])")
_BRACKET = re.compile(rf"{_AT}|{_DOT}", re.I)


def emails(text: str) -> Iterator[tuple[int, int]]:
    """The run of name characters before an @ and the domain after it, left to right."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            yield start, end
        at = text.find("@", max(at + 1, end))


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        if all(len(p) <= 3 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m.group().split("."))):
            yield m.span()


def _luhn(digits: str) -> bool:
    doubled = sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return (doubled + sum(map(int, digits[-1::-2]))) % 10 == 0


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
            yield m.span()


FINDERS = dict(zip(KINDS, (emails, ips, cards, phones)))


def plain(text: str) -> list[tuple[str, int, int]]:
    return [(kind, *span) for kind in KINDS for span in FINDERS[kind](text)]


class _Characters(dict):
    """What each character is written as; looked up once per process."""

    def __missing__(self, c: str) -> str:
        to = _INVISIBLE.get(c, _LOOKALIKES.get(c))
        if to is None and ord(c) > 127:
            form = unicodedata.normalize("NFKC", c)
            digit = unicodedata.decimal(c, None)
            to = str(digit) if digit is not None else form if len(form) == 1 and form.isascii() else c
        self[c] = to = c if to is None else to
        return to


_CHARACTERS = _Characters()


class Written:
    """A normalised text; starts and ends of the source of each character; whether it was changed."""

    def __init__(self):
        self.parts: list[str] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.changed: list[str] = []
        self.left_out = ""

    def copy(self, text: str, of: Written | None, start: int, end: int) -> None:
        self.parts.append(text[start:end])
        if of is None:
            self.starts.extend(range(start, end))
            self.ends.extend(range(start + 1, end + 1))
            self.changed.extend([""] * (end - start))
        else:
            self.starts.extend(of.starts[start:end])
            self.ends.extend(of.ends[start:end])
            self.changed.extend(of.changed[start:end])
        if self.left_out and start < end:
            self.changed[start - end] = self.left_out
            self.left_out = ""

    def put(self, text: str, start: int, end: int, why: str) -> None:
        self.parts.append(text)
        self.starts.extend([start] * len(text))
        self.ends.extend([end] * len(text))
        self.changed.extend([why] * len(text))
        self.left_out = "" if text else why  # then the next character counts as changed


def characters(text: str) -> tuple[str, Written]:
    out, done = Written(), 0
    if not text.isascii():
        for m in re.finditer(r"[^\x00-\x7f]", text):
            dash = m.group() in _DASHES and _DASHED.match(text, m.start())
            to = "-" if dash else _CHARACTERS[m.group()]
            if to != m.group():
                out.copy(text, None, done, m.start())
                out.put(to, m.start(), m.end(), "character")
                done = m.end()
    out.copy(text, None, done, len(text))
    return "".join(out.parts), out


def words(text: str, of: Written) -> tuple[str, Written]:
    out, done = Written(), 0
    for m in _RULES.finditer(text):
        kind = m.lastgroup
        out.copy(text, of, done, m.start())
        if kind == "digits":
            for token in _TOKEN.finditer(text, m.start(), m.end()):
                word = token.group().lower()
                if not word.isalpha():
                    out.copy(text, of, token.start(), token.end())
                    continue
                to = _DIGITS.get(word, "+" if word == "plus" else ".")
                out.put(to, of.starts[token.start()], of.ends[token.end() - 1], kind)
        else:
            out.put("@" if kind.endswith("at") else ".", of.starts[m.start()], of.ends[m.end() - 1], kind)
        done = m.end()
    out.copy(text, of, done, len(text))
    return "".join(out.parts), out


# In a run of digits one that is spelled has another, a number or a dot beside it; cheap to look for.
_BESIDE = re.compile(rf"(?:[0-9]|\b(?:dot|point|{_WORD}))[ ,.-] ?(?:{_WORD})\b|\b(?:{_WORD})[ ,.-] ?(?:[0-9]|dot\b|point\b)")


def _suspect(text: str) -> bool:
    """Whether a transducer would change the text in a way that can matter."""
    if not text.isascii():
        used = set(text)
        if any(_CHARACTERS[c] != c for c in used) or (not used.isdisjoint(_DASHES) and _DASHED.search(text)):
            return True
    low = text.lower()
    if " dot " in low and (" at " in low or "@" in low or any(c in low for c in "0123456789")):
        return True
    if any(c in low for c in ("[", "(", "{", "<", "&", "%40")) and _BRACKET.search(text):
        return True
    if " at " in low and _BARE.search(low):
        return True
    return any(w in low for w in _DIGITS) and _BESIDE.search(low) is not None and _SPELLED.search(text) is not None


def _address(normal: str, changed: list[str]) -> bool:
    """Whether a bare "at" in a find stands for @: by the name before it and the ending after it."""
    name, host = normal.rsplit("@", 1)
    ending = host.rsplit(".", 1)[1].lower()
    spelled = any(c.endswith("dot") for c in changed)
    return name.lower() not in _BEFORE_AT and (ending in _ENDINGS or (spelled and ending.isalpha() and len(ending) == 2))


def disguised(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans found on the normalised text only; none is equal to a plain one of its kind or lies inside it."""
    if not _suspect(text):
        return []
    normal, where = words(*characters(text))
    taken = {k: [(s, e) for kind, s, e in base if kind == k] for k in KINDS}
    found = []
    for kind in KINDS:
        for s, e in FINDERS[kind](normal):
            changed = where.changed[s:e]
            if not any(changed):
                continue
            if "bare_at" in changed and not _address(normal[s:e], changed):
                continue
            start, end = where.starts[s], where.ends[e - 1]
            # A plain find may be a fragment of the real one, which is then added beside it.
            if not any(a <= start and end <= b for a, b in taken[kind]):
                found.append((kind, start, end))
    return found


_SPANS = "array<struct<kind: string, start: long, end: long>>"
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("kind", "start", "end")
    for batch in batches:
        for at in range(0, batch.num_rows, 200):
            part = batch.slice(at, 200)
            base, added = [], []
            for text in part.column(1).to_pylist():
                base.append(plain(text or ""))
                added.append(disguised(text or "", base[-1]))
            yield pa.RecordBatch.from_arrays(
                [part.column(0)] + [
                    pa.array([[dict(zip(names, s)) for s in spans] for spans in rows], _SPAN_TYPE)
                    for rows in (base, added)
                ],
                ["doc_id", "base", "added"],
            )


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base, added), one row per input row: plain and disguised spans (kind, start, end).

    Spans are ordered by kind (email, ip, card, phone) and start. A null text
    counts as empty. Ids may be null or repeat; other columns are not looked at.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan, f"doc_id long, base {_SPANS}, added {_SPANS}")
