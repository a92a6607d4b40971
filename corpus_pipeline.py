"""From raw documents to token ids, in stages; each reads what the one before it wrote.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the
last return the columns of `documents`. Row ids may be null or repeat, texts may
be null or empty; what each operator does then stands in its docstring.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courant.llm import langid
from courant.llm.bpe import decode, encode
from courant.llm.common import batched, table, tokenizer_path, written
from courant.llm.line_dedup import dedup_lines
from courant.llm.mixing import mixed
from courant.llm.near_dedup import near_duplicates
from courant.llm.queries import WEIGHTS
from courant.session import configure

TOKENIZER = "byte_bpe_50k.json"
DOCUMENT = ("doc_id", "text", "lang", "source", "n_chars")

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def any_columns(stage: Stage) -> Stage:
    """A stage that carries further columns of any name: inside they have names that clash with nothing."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        inside = [c if c in DOCUMENT else f"further_column_{i}" for i, c in enumerate(docs.columns)]
        return stage(spark, docs.toDF(*inside), sf_dir).toDF(*docs.columns)

    return run


@any_columns
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised; a missing `lang` is filled with it."""
    batched(configure(spark))
    model = langid.fit(docs)
    rows = docs.withColumn("found", model.column("text")).where("NOT found.rejected")
    return rows.withColumn("lang", F.coalesce("lang", "found.lang_pred")).select(*docs.columns)


@any_columns
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that stand elsewhere before; those left without a line go."""
    configure(spark)
    rows = dedup_lines(docs.drop("n_chars")).where("n_removed IS NULL OR n_removed < n_lines")
    return rows.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


@any_columns
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the smallest id, of each group of near duplicates."""
    batched(configure(spark))
    gone = near_duplicates(docs).where("NOT kept").select(F.col("doc_id").alias("gone"))
    return docs.join(gone, docs["doc_id"] == gone["gone"], "left_anti")


@any_columns
def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents in the order of the mix, across and within the files written."""
    configure(spark)
    return mixed(docs, WEIGHTS, default=1)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(position, doc_id, n_tokens, ids, text): ids of each text and the text they decode to.

    `position` numbers the rows in the order of the files read, which is the mix;
    it leaves gaps between files.
    """
    batched(configure(spark))
    path = tokenizer_path(TOKENIZER)
    part = F.regexp_extract("_metadata.file_name", "part-([0-9]+)", 1).try_cast("long")
    rows = docs.select(
        "doc_id", "text",
        (F.coalesce(part, F.lit(0)) * (1 << 40) + F.col("_metadata.row_index")).alias("position"),
    )
    return decode(encode(rows, path, also_col="position"), path).select(
        "position", "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "text"
    )


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("MinHash near-dedup", near_dedup),
    ("mixing", mixing),
    ("BPE", tokens),
]

#: Trained models and minimum hashes have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)
