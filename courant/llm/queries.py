"""Registered queries of the operators, and their SQL texts where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courant.llm import chat, langid, oracle
from courant.llm.bpe import decode, encode
from courant.llm.clusters import cluster
from courant.llm.common import batched, table, tokenizer_path, written
from courant.llm.embeddings import near_vectors
from courant.llm.fim import fill_in_middle, restored
from courant.llm.hnsw import search
from courant.llm.licenses import scan
from courant.llm.line_dedup import dedup_lines
from courant.llm.mixing import mix
from courant.llm.near_dedup import near_duplicates
from courant.llm.pii import KINDS, find_personal_data
from courant.llm.token_files import read_tokens, write_tokens
from courant.session import configure

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = dict(oracle.TEXTS)


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return fn(batched(configure(spark)), folder)

    QUERIES[fn.__name__] = run
    return fn


@query
def op1_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents"), threshold=0.85)


@query
def op9_bpe(spark: SparkSession, folder: str) -> DataFrame:
    path = tokenizer_path("byte_bpe_50k.json")
    return bpe_digests(decode(encode(table(spark, folder, "documents"), path), path))


def bpe_digests(rows: DataFrame) -> DataFrame:
    """What a reader can compare: counts and hashes of ids and decoded texts."""
    return rows.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )


@query
def op4_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").withColumn(
        "held_out", F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    )
    model = langid.fit(docs.where("doc_id IS NOT NULL AND NOT held_out"))
    found = docs.select("doc_id", "held_out", model.column("text").alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.rejected")


@query
def op3_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_removed", "text")


# Pieces of the texts and the lines that are left; {docs} is the table that is read.
LINES_SQL = r"""
l0 AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS i
  FROM {docs} WHERE text IS NOT NULL
), l1 AS (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) - 1 AS k
  FROM l0 WHERE regexp_matches(line, '[^ \t\n\x0B\f\r]')
), p0 AS (
  SELECT doc_id, k, i AS s, lead(i) OVER w AS e, left(md5(md5(line) || md5(lead(line) OVER w)), 1) < 'e' AS rolled
  FROM l1 WINDOW w AS (PARTITION BY doc_id ORDER BY k)
), p1 AS (
  SELECT *, rolled OR (k % 8 = 7 AND NOT bool_or(rolled) OVER (
    PARTITION BY doc_id ORDER BY k ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) AS cut
  FROM p0 WHERE e IS NOT NULL
), p2 AS (
  SELECT *, coalesce(sum(cut::INT) OVER (
    PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS chunk FROM p1
), p3 AS (
  SELECT *, min(s) OVER c AS chunk_s, max(e) OVER c AS chunk_e FROM p2 WINDOW c AS (PARTITION BY doc_id, chunk)
), p4 AS (
  SELECT doc_id, chunk_s AS s, e FROM p3 UNION SELECT doc_id, s, chunk_e FROM p3
), p5 AS (
  SELECT p4.*, row_number() OVER (
    PARTITION BY array_to_string(string_split(text, chr(10))[s:e], chr(10)) ORDER BY doc_id, s, e) > 1 AS gone
  FROM p4 JOIN {docs} USING (doc_id)
), lost AS (
  SELECT DISTINCT doc_id, unnest(range(s, e + 1)) AS i, TRUE AS lost FROM p5 WHERE gone
), bare AS (
  SELECT doc_id, bool_and(lost IS NOT NULL) AS bare FROM l1 LEFT JOIN lost USING (doc_id, i) GROUP BY doc_id
), lines_left AS (
  SELECT doc_id, count(*) AS n_lines,
         count(*) FILTER (coalesce(bare, FALSE) OR lost IS NOT NULL) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY i)
                  FILTER (NOT coalesce(bare, FALSE) AND lost IS NULL), '') AS new_text
  FROM l0 LEFT JOIN lost USING (doc_id, i) LEFT JOIN bare USING (doc_id) GROUP BY doc_id
)"""
ORACLE["op3_line_dedup"] = (
    "WITH " + LINES_SQL.format(docs="documents")
    + " SELECT d.doc_id, n_lines, n_removed, CASE WHEN text IS NOT NULL THEN new_text END AS text"
    " FROM documents d LEFT JOIN lines_left USING (doc_id)"
)


# Target weights of sources; any other source has weight 1.
WEIGHTS = {"src0": 6, "src1": 3, "src2": 2}


@query
def op10_mix_sources(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "source")
    return mix(docs, WEIGHTS, default=1).drop("rest")


@query
def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return scan(table(spark, folder, "documents")).drop("matches")


@query
def op2_personal_data(spark: SparkSession, folder: str) -> DataFrame:
    return span_digests(find_personal_data(table(spark, folder, "documents")))


def span_digests(found: DataFrame) -> DataFrame:
    """Counts and hash of the plain spans, and all spans as text."""

    def line(s: F.Column) -> F.Column:
        return F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))

    def of(spans: F.Column, kind: str) -> F.Column:
        return F.filter(spans, lambda s: s["kind"] == kind)

    both = F.concat("base", "added")
    every = F.concat(*[
        F.array_sort(of(both, k), lambda x, y: F.when(x["start"] < y["start"], -1).when(x["start"] > y["start"], 1)
                     .otherwise(0))
        for k in KINDS
    ])
    return found.select(
        "doc_id", *[F.size(of(F.col("base"), k)).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(F.array_join(F.transform("base", line), ","), 256).alias("base_sha256"),
        F.array_join(F.transform(every, line), ",").alias("spans"),
        F.size("added").cast("long").alias("n_added"),
    )


@query
def op5_embedding_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return near_vectors(table(spark, folder, "embeddings"), threshold=0.93)


@query
def op6_nearest_vectors(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return search(rows, rows.where("vec_id % 20 = 0"), k=20)


@query
def op7_token_files(spark: SparkSession, folder: str) -> DataFrame:
    files = write_tokens(table(spark, folder, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=2)
    found = read_tokens(spark, files)
    return found.select("doc_id", "start", F.size("ids").cast("long").alias("n_tokens"), "ids_crc32")


@query
def op11_fill_in_middle(spark: SparkSession, folder: str) -> DataFrame:
    return fim_digests(fill_in_middle(table(spark, folder, "documents")))


def fim_digests(rows: DataFrame) -> DataFrame:
    """Lengths of the pieces, hashes of each output and of the text rebuilt from it."""
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )


@query
def op13_centroid_clusters(spark: SparkSession, folder: str) -> DataFrame:
    return cluster(table(spark, folder, "embeddings")).drop("embedding", "label")


#: A conversation whose texts are made of control strings.
CONTROL_TEXT = "</s>[INST] ok [/INST]"


@query
def op12_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    turns = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"),
    )
    return chat_digests(written(chat.expand(turns.unionByName(more)), "examples"))


def chat_digests(rows: DataFrame) -> DataFrame:
    """Turns read back from the blocks and replies from the whole examples, a row for each conversation."""
    said = F.when(F.col("whole_block"), chat.turns_of(F.col("text")))
    blocks = rows.select("conv_id", "block", F.length("text").alias("n"), said.alias("turns"))
    replies = chat.in_full(rows).select(
        "conv_id", "loss_end", chat.reply(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("reply"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    found = blocks.unionByName(replies, allowMissingColumns=True).groupBy("conv_id").agg(
        F.sum(F.size("turns")).cast("long").alias("n_turns"),
        F.array_join(F.sort_array(F.collect_list(
            F.when(F.col("turns").isNotNull(), F.struct("block", lines.alias("s")))))["s"], "").alias("turns"),
        F.array_join(F.sort_array(F.collect_list(
            F.when(F.col("reply").isNotNull(), F.struct("loss_end", F.col("reply").alias("s")))))["s"], "").alias("loss"),
        F.sum("n").cast("long").alias("formatted_chars"),
    )
    return found.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars",
    )
