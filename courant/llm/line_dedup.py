"""Removal of passages of several lines that repeat anywhere in a corpus, without Python.

Lines with text are hashed, and a rolling hash over two neighbouring ones decides
whether a border lies on the second: the same borders in any text that has the
same lines there, however the passage is shifted. A chunk reaches from border to
border and holds the border lines on both sides. A passage rarely starts and ends
on borders, so the heads and tails of a chunk are indexed as well: what a passage
has before its first border is a tail of a chunk, what it has after its last one a
head. A passage is missed only where no border lies on its second line or later.

A piece stays where it stands first (by id, then by place) and goes elsewhere.
Pieces are found by a hash of 64 bits; before anything is removed their bytes are
compared.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courant.functions.urls import let
from courant.llm.common import written

#: A border lies where the first hex digit of the rolling hash is below this one: seven of eight lines.
CUT_BELOW = "e"
#: Where so many lines had no border, one is set; so a chunk stays short where lines repeat within a text.
LONGEST = 8


def _with_text(lines: Column) -> Column:
    """The places of the lines that are not blank."""
    return F.filter(F.sequence(F.lit(0), F.size(lines) - 1), lambda i: F.get(lines, i).rlike(r"\S"))


def borders(hashes: Column) -> Column:
    """For each two neighbours among the hashes of lines: whether a border lies on the second."""

    def rolling(h: Column) -> Column:
        return F.transform(F.slice(h, 2, F.size(h)), lambda x, k: F.md5(F.concat(F.get(h, k), x)))

    def bounded(cut: Column) -> Column:
        def long(k: Column) -> Column:
            before = F.slice(cut, F.greatest(k - (LONGEST - 2), F.lit(1)), LONGEST - 1)
            return (k % LONGEST == LONGEST - 1) & ~F.exists(before, lambda x: x)

        return F.transform(cut, lambda x, k: x | long(k))

    return let(F.transform(rolling(hashes), lambda r: F.substring(r, 1, 1) < CUT_BELOW), bounded)


def pieces(lines: Column) -> Column:
    """array(struct(start, end)): the chunks, their heads and their tails, as line numbers, the end exclusive."""

    def of(at: Column, ends: Column) -> Column:
        def piece(first: Column, last: Column) -> Column:
            return F.struct(F.get(at, first).alias("start"), (F.get(at, last + 1) + 1).alias("end"))

        def chunk(s: Column, e: Column) -> Column:
            own = F.sequence(s, e)
            return F.concat(
                F.transform(own, lambda k: piece(s, k)),
                F.transform(F.filter(own, lambda k: k > s), lambda k: piece(k, e)),
            )

        return F.flatten(F.transform(ends, lambda e, j: let(
            F.when(j == 0, 0).otherwise(F.get(ends, j - 1) + 1), lambda s: chunk(s, e)
        )))

    def ends(cut: Column) -> Column:
        return F.filter(F.transform(cut, lambda _, k: k), lambda k: F.get(cut, k) | (k == F.size(cut) - 1))

    return let(_with_text(lines), lambda at: let(
        let(borders(F.transform(at, lambda i: F.md5(F.get(lines, i)))), ends), lambda e: of(at, e)
    ))


def _text(lines: Column, place: Column) -> Column:
    return F.array_join(F.slice(lines, place["start"] + 1, place["end"] - place["start"]), "\n")


def _without(text: Column, gone: Column) -> Column:
    """struct(text, removed): a text without the lines of the pieces `gone`; blank lines do not stay alone."""

    def left(lines: Column, at: Column) -> Column:
        lost = F.flatten(F.transform(gone, lambda p: F.sequence(p["start"], p["end"] - 1)))
        kept = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost)
        bare = F.size(F.array_except(at, lost)) == 0
        return let(F.when(bare, F.slice(kept, 1, 0)).otherwise(kept), lambda kept: F.struct(
            F.array_join(F.transform(kept, lambda i: F.get(lines, i)), "\n").alias("text"),
            (F.size(lines) - F.size(kept)).alias("removed"),
        ))

    return let(F.split(text, "\n", -1), lambda lines: let(_with_text(lines), lambda at: left(lines, at)))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of `docs` with repeated passages taken out of the text, plus n_lines and n_removed.

    A line goes where it stands in a piece of two or more lines with text that stands
    elsewhere before; blank lines between them go, too. The first place of a line is always kept.
    Rows equal in id and text count as one document, and each keeps what the
    others keep. A null text stays null with null counts; an empty one is one empty line. A
    text with no line with text left is empty. A null id comes before all others. Where
    different texts share a hash, nothing is removed. Columns of `docs` named
    n_lines or n_removed are replaced.
    """
    own = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    renamed = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(own)]
    rows = docs.select(*renamed)
    doc_id, text = f"c{own.index(id_col)}", f"c{own.index(text_col)}"
    rows = rows.withColumn("mark", F.xxhash64(text))
    key = [doc_id, "mark"]
    found = let(F.split(text, "\n", -1), lambda lines: F.transform(
        pieces(lines), lambda p: F.struct(p.alias("at"), F.xxhash64(_text(lines, p)).alias("hash"))
    ))
    seen = rows.where(f"{text} IS NOT NULL").select(*key, F.explode(found).alias("part"))
    seen = written(seen.select(*key, "part.at", "part.hash"), "pieces")
    often = seen.groupBy("hash").agg(F.count("*").alias("n")).where("n > 1").select("hash")
    repeated = written(seen.join(often, "hash"), "repeated")

    def same(left: DataFrame, right: DataFrame) -> Column:
        return left[doc_id].eqNullSafe(right[f"{doc_id}_"]) & (left["mark"] == right["mark_"])

    def listed(df: DataFrame, value: Column, name: str) -> DataFrame:
        return df.groupBy(F.col(doc_id).alias(f"{doc_id}_"), F.col("mark").alias("mark_")).agg(
            F.collect_set(value).alias(name)
        )

    wanted = listed(repeated, F.col("at"), "wanted")
    # `row` has every column pass the join, so that this and the last join read one exchange.
    every = [F.col(f"c{i}") for i in range(len(own))]
    texts = (
        rows.join(wanted, same(rows, wanted))
        .select(*key, F.xxhash64(*every).alias("row"), let(
            F.split(text, "\n", -1),
            lambda lines: F.transform(F.col("wanted"), lambda p: F.struct(p.alias("at"), _text(lines, p).alias("text"))),
        ).alias("found"))
        .select(*key, "row", F.explode("found").alias("found"))
        .select(F.struct(doc_id, "mark", "found.at", "row").alias("place"), F.col("found.text").alias("text"))
    )
    texts = texts.groupBy("text").agg(F.min("place").alias("place"))
    first = texts.groupBy(F.xxhash64("text").alias("hash")).agg(
        F.min("place").alias("place"), F.count("*").alias("texts")
    ).where("texts = 1")
    first = first.select(
        "hash", F.col(f"place.{doc_id}").alias("first_id"), F.col("place.mark").alias("first_mark"),
        F.col("place.at").alias("first_at"),
    )
    again = repeated.join(first, "hash").where(
        ~(F.col(doc_id).eqNullSafe(F.col("first_id")) & (F.col("mark") == F.col("first_mark"))
          & (F.col("at") == F.col("first_at")))
    )
    gone = listed(again, F.col("at"), "gone")
    full = rows.join(gone, same(rows, gone), "left")
    kept = full.withColumn(
        "done",
        F.when(F.col("gone").isNull(), F.struct(F.col(text).alias("text"), F.lit(0).alias("removed"))).otherwise(
            _without(F.col(text), F.col("gone"))
        ),
    )
    out = [
        F.col("done.text").alias(c) if f"c{i}" == text else F.col(f"c{i}").alias(c) for i, c in enumerate(own)
    ]
    given = F.col(text).isNotNull()
    return kept.select(
        *out,
        F.when(given, F.size(F.split(text, "\n", -1))).cast("long").alias("n_lines"),
        F.when(given, F.col("done.removed")).cast("long").alias("n_removed"),
    )
