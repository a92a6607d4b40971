"""Links and article text out of HTML pages, as native expressions.

This is a documented subset of HTML, not a full parser: comments, scripts and
styles are taken out first; an element ends at its balanced end tag; a paragraph
or an anchor ends at its end tag or where the next one starts; the five XML
entities and `&nbsp;` are decoded.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from courant.functions.urls import join_parts, let, url_path, url_scheme

_MARK = "\u0001"
_ATTRS = r"""(?:[^>"']++|"[^"]*"|'[^']*')*+"""
_ANCHOR = r"(?i:<a)(?=[\s>/])"
_BLANKS = " \t\n\r\f\x0b\u00a0\u3000"

# Limits and phrases of the paragraph filters.
MIN_PATH, MIN_TITLE = 5, 4
SUMMARY_CHARS = 140
SUMMARY_MIN_PARAGRAPH, ARTICLE_MIN_PARAGRAPH = 10, 15
SUMMARY_PHRASES = (
    "版权所有", "转载请注明", "相关阅读", "点击进入", "网站地图", "关于我们",
    "English", "联系我们", "免责声明", "隐私政策", "订阅", "分享到",
)
ARTICLE_PHRASES = SUMMARY_PHRASES + (
    "责任编辑", "来源：", "编辑：", "审核：",
    "更多精彩", "扫一扫", "关注公众号", "下载APP",
)
SUMMARY_AREAS = ("article", "main", ".content", ".article-content", "#content", ".post-content")
ARTICLE_AREAS = (
    "article", "main", ".content", ".article-content", ".post-content",
    "#content", "#article", "#main", ".detail", ".text", ".entry-content",
    "[class*='article']", "[class*='content']", "[id*='article']",
)
SUMMARY_NOISE = ("script", "style", "nav", "footer", "aside")
ARTICLE_NOISE = SUMMARY_NOISE + ("header", "iframe", "form", "button", "noscript")


@dataclass(frozen=True)
class Selector:
    """One simple selector, as patterns for an opening tag at the start of a text."""

    tag: str | None
    attr: str | None
    value: str | None
    partial: bool = False

    @classmethod
    def parse(cls, text: str) -> Selector:
        m = re.fullmatch(r"([A-Za-z][A-Za-z0-9]*)?(?:([.#])([\w-]+))?", text)
        if m and text:
            attr = {".": "class", "#": "id", None: None}[m[2]]
            return cls(m[1].lower() if m[1] else None, attr, m[3])
        m = re.fullmatch(r"\[(class|id)\*='([\w-]+)'\]", text)
        if m:
            return cls(None, m[1], m[2], True)
        raise ValueError(f"selector not supported: {text!r}")

    @property
    def pattern(self) -> str:
        name = self.tag or "[A-Za-z][A-Za-z0-9]*"
        head = rf"<(?i:{name})(?=[\s>/])"
        if self.attr is None:
            return head
        word = re.escape(self.value)
        if self.partial:
            quoted = rf""""[^"]*{word}[^"]*"|'[^']*{word}[^']*'|[^\s>"']*{word}"""
        elif self.attr == "id":
            quoted = rf""""{word}"|'{word}'|{word}(?=[\s>])"""
        else:
            quoted = (
                rf""""(?:[^"]*\s)?{word}(?:\s[^"]*)?"|'(?:[^']*\s)?{word}(?:\s[^']*)?'"""
                rf"""|{word}(?=[\s>])"""
            )
        return rf"{head}[^>]*?\s(?i:{self.attr})\s*=\s*(?:{quoted})"


def parse_selector(text: str | None) -> list[Selector]:
    """Steps of a descendant selector; empty means all anchors.

    Each step is `tag`, `.class`, `tag.class`, `#id` or `tag#id`. Anything else
    is an error rather than a silent fallback.
    """
    return [Selector.parse(step) for step in (text or "a").split()]


def without_code(html: Column) -> Column:
    """The page without comments, scripts and styles."""
    return F.regexp_replace(
        F.regexp_replace(html, r"(?s)<!--.*?-->", ""),
        r"(?is)<(script|style)(?=[\s>]).*?</\1\s*>", "",
    )


def without_elements(html: Column, tags: Sequence[str]) -> Column:
    """The page without the elements of these tags, each up to its balanced end tag.

    One that is never closed goes on to the end, as it does in a parser.
    """
    names = "|".join(tags)

    def tag_name(piece: Column) -> Column:
        return F.lower(F.regexp_extract(piece, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))

    def step(state: Column, piece: Column) -> Column:
        inside, closing = state["depth"] > 0, F.startswith(piece, F.lit("</"))
        turn = F.when(closing, -1).otherwise(1)
        depth = (
            F.when(~inside, F.when(closing, 0).otherwise(1))
            .when(tag_name(piece) == state["name"], state["depth"] + turn).otherwise(state["depth"])
        )
        after = F.regexp_replace(piece, "^</[^>]*>", "")
        return F.struct(
            depth.alias("depth"),
            F.when(~inside & ~closing, tag_name(piece)).otherwise(state["name"]).alias("name"),
            F.when(closing & (depth == 0), F.array_append(state["kept"], after)).otherwise(state["kept"]).alias("kept"),
        )

    def rest(pieces: Column) -> Column:
        start = F.struct(F.lit(0).alias("depth"), F.lit("").alias("name"), F.slice(pieces, 1, 1).alias("kept"))
        return F.aggregate(
            F.slice(pieces, F.lit(2), F.size(pieces)), start, step, lambda s: F.array_join(s["kept"], "")
        )

    marked = F.regexp_replace(html, rf"(?i)(</?(?:{names})(?=[\s>/]))", f"{_MARK}$1")
    return F.when(html.rlike(rf"(?i)<(?:{names})[\s>/]"), let(F.split(marked, _MARK), rest)).otherwise(html)


def decode_entities(text: Column) -> Column:
    """The five XML entities; `&amp;` last, so that nothing is decoded twice."""
    for entity, char in (
        ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
        ("&amp;", "&"),
    ):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return text


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_BLANKS))


def text_of(html: Column) -> Column:
    """Text of a fragment: text nodes stripped and joined with nothing between."""
    spaced = F.replace(html, F.lit("&nbsp;"), F.lit("\u00a0"))
    nodes = F.transform(F.split(F.regexp_replace(spaced, "<[^>]*>", _MARK), _MARK), strip)
    return decode_entities(F.array_join(nodes, ""))


def _pieces(html: Column, start: str) -> Column:
    """The parts of a text from each match of `start` to the next one."""
    marked = F.regexp_replace(html, f"({start})", f"{_MARK}$1")
    return F.filter(F.split(marked, _MARK), lambda p, i: i > 0)


def element_blocks(html: Column, selector: Selector, outer: bool = False) -> Column:
    """Inner (or outer) HTML of every outermost element the selector matches, in page order."""
    pieces = _pieces(html, rf"(?i:</?{selector.tag})(?=[\s>/])" if selector.tag else r"</?[A-Za-z]")

    def tag_name(piece: Column) -> Column:
        return F.lower(F.regexp_extract(piece, r"^</?([A-Za-z][A-Za-z0-9]*)", 1))

    def step(state: Column, piece: Column) -> Column:
        inside = state["depth"] > 0
        turn = (
            F.when(tag_name(piece) != state["name"], 0)
            .when(F.startswith(piece, F.lit("</")), -1)
            .otherwise(1)
        )
        depth = (
            F.when(inside, state["depth"] + turn)
            .when(piece.rlike("^" + selector.pattern), 1)
            .otherwise(0)
        )
        opened = ~inside & (depth == 1)
        return F.struct(
            depth.alias("depth"),
            F.when(opened, tag_name(piece)).otherwise(state["name"]).alias("name"),
            F.when(opened | (depth > 0), F.array_append(state["kept"], piece))
            .when(inside, F.array_append(state["kept"], F.lit(_MARK)))
            .otherwise(state["kept"]).alias("kept"),
        )

    start = F.struct(
        F.lit(0).alias("depth"), F.lit("").alias("name"),
        F.array().cast("array<string>").alias("kept"),
    )
    kept = F.aggregate(pieces, start, step, lambda s: s["kept"])
    blocks = F.filter(F.split(F.array_join(kept, ""), _MARK), lambda b: b != "")
    return blocks if outer else F.transform(blocks, lambda b: F.regexp_replace(b, rf"^<{_ATTRS}>", ""))


def first_element(html: Column, selectors: Sequence[Selector]) -> Column:
    """Inner HTML of the first element of the first selector that matches any; else null."""

    def inner(pieces: Column) -> Column:
        def step(state: Column, piece: Column) -> Column:
            depth = state["depth"] + F.when(F.startswith(piece, F.lit("</")), -1).otherwise(1)
            taken = state["taken"] + (depth > 0).cast("int")
            return F.when(state["depth"] == 0, state).otherwise(
                F.struct(depth.alias("depth"), taken.alias("taken"))
            )

        start = F.struct(F.lit(1).alias("depth"), F.lit(1).alias("taken"))
        rest = F.slice(pieces, F.lit(2), F.size(pieces))
        taken = F.aggregate(rest, start, step, lambda s: s["taken"])
        return F.array_join(F.slice(pieces, F.lit(1), taken), "")

    def cut(rest: Column) -> Column:
        name = F.lower(F.regexp_extract(rest, r"^<([A-Za-z][A-Za-z0-9]*)", 1))
        same_tag = F.concat(F.lit("(?i)(</?"), name, F.lit(r"(?=[\s>/]))"))
        marked = F.regexp_replace(rest, same_tag, F.lit(f"{_MARK}$1"))
        return let(F.filter(F.split(marked, _MARK), lambda p: p != ""), inner)

    found = [F.nullif(F.regexp_extract(html, f"(?s){s.pattern}.*", 0), F.lit("")) for s in selectors]
    return F.regexp_replace(let(F.coalesce(*found), cut), rf"^<{_ATTRS}>", "")


def content_area(html: Column, areas: Sequence[str]) -> Column:
    """The first area found, in the order of the list; else the body, else the page."""
    return F.coalesce(first_element(html, [Selector.parse(area) for area in [*areas, "body"]]), html)


def _attribute(attrs: Column, name: str) -> Column:
    quoted = F.regexp_extract(
        attrs, rf"""(?i)[\s"']{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1
    )
    return decode_entities(F.regexp_replace(quoted, r"""^["']|["']$""", ""))


def anchors(html: Column, selector: str | None = None) -> Column:
    """Anchors the selector chooses: array of (attrs, inner), in page order.

    A selector ending in `a…` means those anchors. Any other means the anchors
    among the elements it matches and all anchors inside the others.
    """
    steps = parse_selector(selector)
    direct = steps[-1].tag == "a"
    last = steps.pop() if direct else Selector("a", None, None)
    scope = without_code(html)
    for i, step in enumerate(steps, 1):
        scope = F.array_join(element_blocks(scope, step, outer=not direct and i == len(steps)), "")
    found = F.filter(_pieces(scope, _ANCHOR), lambda p: p.rlike("^" + last.pattern))
    return F.transform(found, anchor_of)


def anchor_of(piece: Column) -> Column:
    """(attrs, inner) of a piece that starts with an anchor's tag."""
    return F.struct(
        F.regexp_extract(piece, rf"^<[aA]({_ATTRS})>", 1).alias("attrs"),
        F.regexp_replace(
            F.regexp_replace(piece, rf"^<[aA]{_ATTRS}>", ""), r"(?is)</a(?=[\s>]).*$", ""
        ).alias("inner"),
    )


def count_selected(html: Column, selector: str | None = None) -> Column:
    """How many elements, of any tag, the selector matches."""
    *steps, last = parse_selector(selector)
    scope = without_code(html)
    for step in steps:
        scope = F.array_join(element_blocks(scope, step), "")
    tags = _pieces(scope, rf"(?i:<{last.tag or '[A-Za-z][A-Za-z0-9]*'})(?=[\s>/])")
    return F.size(F.filter(tags, lambda p: p.rlike("^" + last.pattern)))


def link_targets(found: Column, base: Column) -> Column:
    """Anchors with a usable target: array of (pos, url, title), not yet distinct.

    `base` is the page's url as `split_base` gives it.
    """
    hrefs = F.transform(
        found,
        lambda a, i: F.struct(
            i.alias("pos"), strip(_attribute(a["attrs"], "href")).alias("href"),
            a["attrs"].alias("attrs"), a["inner"].alias("inner"),
        ),
    )
    usable = F.filter(
        hrefs,
        lambda a: (a["href"] != "")
        & ~F.startswith(a["href"], F.lit("#"))
        & ~F.startswith(a["href"], F.lit("javascript:")),
    )
    joined = F.transform(
        usable,
        lambda a: F.struct(
            a["pos"].alias("pos"), join_parts(base, a["href"]).alias("url"),
            let(
                text_of(a["inner"]),
                lambda t: F.when(t != "", t).otherwise(strip(_attribute(a["attrs"], "title"))),
            ).alias("title"),
        ),
    )
    return F.filter(
        joined,
        lambda a: url_scheme(a["url"]).isin("http", "https")
        & (F.length(url_path(a["url"])) >= MIN_PATH),
    )


def paragraphs(area: Column) -> Column:
    """Texts of the paragraphs of an area, in page order."""
    return F.transform(
        _pieces(area, r"(?i:<p)(?=[\s>/])"),
        lambda p: text_of(
            F.regexp_replace(
                F.regexp_replace(p, rf"^<[pP]{_ATTRS}>", ""), r"(?is)</p(?=[\s>]).*$", ""
            )
        ),
    )


def _count_of(text: Column, part: str) -> Column:
    gone = F.replace(text, F.lit(part), F.lit(""))
    return (F.length(text) - F.length(gone)) / F.lit(len(part))


def paragraph_fault(text: Column, for_summary: bool) -> Column:
    """Why a paragraph is left out, or null if it is kept."""
    shortest = SUMMARY_MIN_PARAGRAPH if for_summary else ARTICLE_MIN_PARAGRAPH
    phrases = SUMMARY_PHRASES if for_summary else ARTICLE_PHRASES
    fault = (
        F.when(F.length(text) < shortest, "short")
        .when(reduce(or_, [F.contains(text, F.lit(p)) for p in phrases]), "phrase")
        .when(_count_of(text, "|") >= 3, "links")
    )
    if for_summary:
        return fault
    return fault.when(_count_of(text, ">>") >= 2, "links").when(
        F.regexp_replace(text, "[ .,]", "").rlike(r"^\d+$"), "digits"
    )


def clip(text: Column, limit: int) -> Column:
    """At most `limit` characters, with dots where something was cut off."""
    return F.when(
        F.length(text) > limit, F.concat(F.substring(text, 1, limit), F.lit("..."))
    ).otherwise(text)


def summary_area(html: Column) -> Column:
    return without_elements(content_area(without_code(html), SUMMARY_AREAS), SUMMARY_NOISE)


def article_area(html: Column) -> Column:
    """As the summary's, with more areas and more noise. Only tags are taken out."""
    return without_elements(content_area(without_code(html), ARTICLE_AREAS), ARTICLE_NOISE)


def extract_summary(html: Column, limit: int = SUMMARY_CHARS) -> Column:
    """Leading paragraphs until `limit` characters are reached, then clipped."""
    good = F.filter(paragraphs(summary_area(html)), lambda p: paragraph_fault(p, True).isNull())
    text = F.aggregate(
        good, F.lit(""),
        lambda done, p: F.when(F.length(done) >= limit, done).otherwise(F.concat(done, p)),
    )
    return F.coalesce(let(text, lambda t: clip(t, limit)), F.lit(""))


def extract_article_text(html: Column) -> Column:
    """All good paragraphs, blank lines between them."""
    good = F.filter(paragraphs(article_area(html)), lambda p: paragraph_fault(p, False).isNull())
    return F.coalesce(F.array_join(good, "\n\n"), F.lit(""))
