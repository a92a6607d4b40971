"""Reading a summarizer's free-text answer, and the text given to it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courant.functions.html import SUMMARY_CHARS, clip, strip
from courant.functions.urls import let

# Prefixes removed from answers, and the limits of a body text.
TITLE_PREFIXES = (
    "News", "news", "新闻", "标题：", "标题:",
    "Coal", "Electricity", "Natural Gas", "Oil", "Renewables",
    "Bioenergy", "Nuclear", "Hydrogen", "Energy Efficiency",
)
SUMMARY_PREFIXES = ("摘要：", "摘要:", "本文", "文章", "新闻")
TITLE_LINE_CHARS = 30
BODY_CHARS, HALF_BODY_CHARS = 5000, 2500
OMITTED = "\n\n[中间部分省略]\n\n"
MIN_BODY_CHARS, MIN_BODY_CHARS_EN = 100, 50

# What is asked of the summarizer, by language; `%s` are title and body.
PROMPTS = {
    "en": (
        "把下面的英文标题译成中文，并用不超过 {n} 个汉字概括正文。"
        "只输出一行：中文标题|中文摘要\n\n标题：\n%s\n\n正文：\n%s"
    ),
    "zh": "用不超过 {n} 个汉字概括下面的新闻，只输出摘要。\n\n标题：\n%s\n\n正文：\n%s",
}


def _by_lines(lines: Column, original: Column) -> Column:
    first, second = F.get(lines, F.lit(0)), F.get(lines, F.lit(1))
    long_single = second.isNull() & (F.length(first) > TITLE_LINE_CHARS)
    title = F.when(first.isNull() | long_single, original).otherwise(first)
    summary = F.when(second.isNotNull(), second).when(long_single, first).otherwise(F.lit(""))
    return F.struct(title.alias("title"), summary.alias("summary"))


def split_answer(answer: Column, original: Column) -> Column:
    """(title, summary) out of an answer: by the first bar, else by lines."""
    text = strip(answer)
    halves = F.split(text, "[|]", 2)
    lines = F.filter(F.transform(F.split(text, "\n"), strip), lambda s: s != "")
    return F.when(
        F.contains(text, F.lit("|")),
        F.struct(strip(F.get(halves, F.lit(0))).alias("title"), strip(F.get(halves, F.lit(1))).alias("summary")),
    ).otherwise(let(lines, lambda v: _by_lines(v, original)))


def strip_title_prefix(title: Column) -> Column:
    """Remove the first prefix of the list that matches, once."""
    result = title
    for prefix in reversed(TITLE_PREFIXES):
        rest = strip(F.substring(title, len(prefix) + 1, 2147483647))
        result = F.when(F.startswith(title, F.lit(prefix)), rest).otherwise(result)
    return result


def strip_summary_prefixes(summary: Column) -> Column:
    """Remove each prefix of the list in turn, so several can go."""
    return F.aggregate(
        F.array(*[F.lit(p) for p in SUMMARY_PREFIXES]), summary,
        lambda text, prefix: F.when(
            F.startswith(text, prefix), strip(F.substr(text, F.length(prefix) + 1))
        ).otherwise(text),
    )


def read_answer(lang: Column, answer: Column, original: Column, limit: int = SUMMARY_CHARS) -> Column:
    """(title, summary) from an answer: English sources get a new title, others keep theirs."""
    parts = split_answer(answer, original)
    english = let(
        parts,
        lambda p: F.struct(
            strip_title_prefix(p["title"]).alias("title"), clip(p["summary"], limit).alias("summary")
        ),
    )
    other = F.struct(
        original.alias("title"),
        let(strip_summary_prefixes(strip(answer)), lambda s: clip(s, limit)).alias("summary"),
    )
    return F.when(lang == "en", english).otherwise(other)


def or_extract(summary: Column, extracted: Column) -> Column:
    """The summary given, else the extracted one, else the empty text."""
    return F.coalesce(F.nullif(summary, F.lit("")), extracted, F.lit(""))


def head_and_tail(text: Column) -> Column:
    """A long text's first and last part, with a mark between."""
    return F.when(
        F.length(text) > BODY_CHARS,
        F.concat(
            F.substring(text, 1, HALF_BODY_CHARS), F.lit(OMITTED),
            F.substring(text, -HALF_BODY_CHARS, HALF_BODY_CHARS),
        ),
    ).otherwise(text)


def long_enough(text: Column, lang: Column) -> Column:
    return F.length(text) >= F.when(lang == "en", MIN_BODY_CHARS_EN).otherwise(MIN_BODY_CHARS)


def prompt(lang: Column, title: Column, body: Column, limit: int = SUMMARY_CHARS) -> Column:
    cut = head_and_tail(body)
    text = {key: value.replace("{n}", str(limit)) for key, value in PROMPTS.items()}
    return F.when(lang == "en", F.format_string(text["en"], title, cut)).otherwise(
        F.format_string(text["zh"], title, cut)
    )
