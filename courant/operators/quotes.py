"""Watch-list items matched with a market snapshot."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courant.session import small_side
from courant.sources.tables import first_per_key

# Name keywords per commodity prefix, in order of preference.
COMMODITY_WORDS = {
    "cu": ["铜", "Copper", "Cu"],
    "al": ["铝", "Aluminum", "Al"],
    "lc": ["锂", "碳酸锂", "氢氧化锂", "Lithium"],
}
PREFERRED_WORD = "综合"

A_SHARE, HONG_KONG, COMMODITY = "cn", "hk", "global"
BY_PREFIX = "prefix"  # the kind of key that stands for no market


def parse_pct(text: Column) -> Column:
    """`+0.19%` or a plain number; null for anything else."""
    return F.trim(F.replace(text, F.lit("%"), F.lit(""))).try_cast("double")


def valid_price(price: Column) -> Column:
    return (price != 0) & ~F.isnan(price)


def display_name(configured: Column, found: Column, symbol: Column) -> Column:
    return F.coalesce(F.nullif(configured, F.lit("")), found, symbol)


def first_by_code(snapshot: DataFrame, market: str) -> DataFrame:
    """One snapshot row per code of a market, the first by position."""
    rows = snapshot.where(F.col("market") == market)
    return first_per_key(rows, ["code"], ["pos"], ["name", "last", "change_pct"]).select(
        "code", F.col("name").alias("found_name"), "last", "change_pct"
    )


def _matched(items: DataFrame, rows: DataFrame, on: Column) -> DataFrame:
    side = rows.withColumnRenamed("code", "_code")
    return items.withColumn("_code", on).join(side, "_code").drop("_code")


def stock_quotes(items: DataFrame, snapshot: DataFrame, market: str) -> DataFrame:
    """Items joined on code. The price is not checked; a missing code gives no row."""
    return _matched(items, first_by_code(snapshot, market), F.col("symbol"))


def commodity_by_code(items: DataFrame, snapshot: DataFrame) -> DataFrame:
    return _matched(items, first_by_code(snapshot, COMMODITY), F.upper("symbol"))


def prefix_hits(name: Column, words: Mapping[str, Sequence[str]]) -> Column:
    """array<struct(prefix, word_pos)>: the prefixes whose words a name has.

    The word list is fixed and short, so every snapshot row is tested against it
    in place; there is no join on `contains`.
    """
    wanted = F.array(*[
        F.struct(F.lit(p).alias("prefix"), F.lit(i).alias("word_pos"), F.lit(w.lower()).alias("word"))
        for p, ws in words.items() for i, w in enumerate(ws)
    ])
    return F.filter(wanted, lambda w: F.contains(F.lower(name), w["word"]))


def commodity_by_prefix(
    snapshot: DataFrame, words: Mapping[str, Sequence[str]], preferred: str
) -> DataFrame:
    """The snapshot row each commodity prefix stands for: the first word with any row, its best row."""
    hits = (
        snapshot.where(F.col("market") == COMMODITY)
        .withColumn("_hit", F.explode(prefix_hits(F.col("name"), words)))
        .select(
            "_hit.prefix", "_hit.word_pos", (~F.contains("name", F.lit(preferred))).alias("plain"),
            "pos", "name", "last", "change_pct",
        )
    )
    return first_per_key(
        hits, ["prefix"], ["word_pos", "plain", "pos"], ["name", "last", "change_pct"]
    ).select("prefix", F.col("name").alias("found_name"), "last", "change_pct")


def best_by_key(
    snapshot: DataFrame, asked: DataFrame, words: Mapping[str, Sequence[str]], preferred: str
) -> DataFrame:
    """(_kind, _key, _row): for each key asked for, the one snapshot row it stands for.

    A snapshot row answers to its (market, code) and, as a commodity, to every
    prefix one of whose words its name has. One scan emits all keys, those nobody
    asked for are dropped before the shuffle, and one minimum per key chooses.
    """
    plain = ~F.contains("name", F.lit(preferred))
    code = F.struct(F.col("market").alias("_kind"), F.col("code").alias("_key"), F.lit(0).alias("word_pos"), F.lit(False).alias("plain"))
    by_word = F.transform(prefix_hits(F.col("name"), words), lambda w: F.struct(
        F.lit(BY_PREFIX).alias("_kind"), w["prefix"].alias("_key"), w["word_pos"].alias("word_pos"), plain.alias("plain")))
    none = F.slice(by_word, 1, 0)
    hits = F.coalesce(F.when(F.col("market") == COMMODITY, by_word).otherwise(none), none)
    keyed = snapshot.select(
        F.explode(F.concat(F.array(code), hits)).alias("k"), "pos", F.col("name").alias("found_name"), "last", "change_pct"
    ).select("k.*", "pos", "found_name", "last", "change_pct")
    wanted = keyed.join(small_side(asked.select("_kind", "_key").distinct()), ["_kind", "_key"], "left_semi")
    return wanted.groupBy("_kind", "_key").agg(
        F.min_by(F.struct("found_name", "last", "change_pct"), F.struct("word_pos", "plain", "pos")).alias("_row"))


def commodity_quotes(
    items: DataFrame,
    snapshot: DataFrame,
    words: Mapping[str, Sequence[str]] = COMMODITY_WORDS,
    preferred: str = PREFERRED_WORD,
) -> DataFrame:
    """Items matched by exact code, else by the words of their prefix."""
    exact = F.struct("found_name", "last", "change_pct")
    by_code = first_by_code(snapshot, COMMODITY).select(F.col("code").alias("_code"), exact.alias("_exact"))
    by_prefix = commodity_by_prefix(snapshot, words, preferred).select(
        F.col("prefix").alias("_prefix"), exact.alias("_similar")
    )
    prefix = F.when(F.length("symbol") >= 2, F.lower(F.substring("symbol", 1, 2)))
    return (
        items.withColumn("_code", F.upper("symbol"))
        .withColumn("_prefix", prefix)
        .join(by_code, "_code", "left")
        .join(F.broadcast(by_prefix), "_prefix", "left")  # at most one row per listed prefix
        .withColumn("_row", F.coalesce("_exact", "_similar"))
        .where(F.col("_row").isNotNull())
        .withColumn("method", F.when(F.col("_exact").isNotNull(), "code").otherwise("name"))
        .select(*items.columns, "method", "_row.found_name", "_row.last", "_row.change_pct")
    )


def fetch_quotes(
    items: DataFrame,
    snapshot: DataFrame,
    as_of: Column,
    words: Mapping[str, Sequence[str]] = COMMODITY_WORDS,
    preferred: str = PREFERRED_WORD,
) -> DataFrame:
    """Quotes for all items by their type; items that match nothing give no row.

    One pass over the snapshot finds the row of every key asked for; only
    commodities fall back to the words of their prefix, and only their price is checked. Hong Kong
    quotes are typed `stock`, so they are reported with the stocks. `item_pos`
    carries the order of the watch-list.
    """
    is_futures = F.coalesce(F.col("item_type") == "futures", F.lit(False))
    market = F.when(is_futures, COMMODITY).when(F.col("item_type") == "stock_hk", HONG_KONG).otherwise(A_SHARE)
    has_prefix = is_futures & F.coalesce(F.length("symbol") >= 2, F.lit(False))
    keyed = items.withColumns({
        "_futures": is_futures, "_market": market,
        "_code": F.when(is_futures, F.upper("symbol")).otherwise(F.col("symbol")),
        # Items without a prefix keep keys of their own, so that they are dealt out like the others.
        "_by": F.when(has_prefix, BY_PREFIX).otherwise(""),
        "_prefix": F.when(has_prefix, F.lower(F.substring("symbol", 1, 2))).otherwise(F.col("symbol")),
    })
    asked = keyed.select(F.explode(F.array(
        F.struct(F.col("_market").alias("_kind"), F.col("_code").alias("_key")),
        F.struct(F.col("_by").alias("_kind"), F.col("_prefix").alias("_key")),
    )).alias("k")).select("k.*")
    found = best_by_key(snapshot, asked, words, preferred)
    # The same rows twice, so both joins read one exchange and the snapshot is scanned once.
    exact = found.select(F.col("_kind").alias("_market"), F.col("_key").alias("_code"), F.col("_row").alias("_exact"))
    similar = found.select(F.col("_kind").alias("_by"), F.col("_key").alias("_prefix"), F.col("_row").alias("_similar"))
    pct, last = parse_pct(F.col("_row.change_pct")), F.col("_row.last")
    return (
        keyed.join(exact, ["_market", "_code"], "left").join(similar, ["_by", "_prefix"], "left")
        .withColumn("_row", F.coalesce("_exact", "_similar"))
        .where(last.isNotNull() & pct.isNotNull() & (~F.col("_futures") | valid_price(last)))
        .select(
            "industry_id", "item_pos",
            display_name(F.col("name"), F.col("_row.found_name"), F.col("symbol")).alias("name"),
            "symbol", F.round(last, 2).alias("price"), F.round(pct, 2).alias("change_pct"),
            F.when(F.col("_futures"), "futures").otherwise("stock").alias("item_type"),
            as_of.alias("quoted_at"),
        )
    )


def coverage(items: DataFrame, quotes: DataFrame) -> DataFrame:
    """Per industry: items asked for and items found."""
    found = quotes.select("item_pos", F.lit(1).alias("_found"))
    return items.join(found, "item_pos", "left").groupBy("industry_id").agg(
        F.count("*").alias("requested"), F.count("_found").alias("found"),
    )


def missing_items(items: DataFrame, quotes: DataFrame) -> DataFrame:
    """The items no quote was found for, as rows."""
    return items.join(quotes.select("item_pos"), "item_pos", "left_anti")
