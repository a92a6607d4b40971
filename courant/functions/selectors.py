"""Any number of selectors as data: each row names its own, one fold over its page matches it.

A selector becomes an array of steps, a page an array of tags; a fold over the
tags keeps the stack of steps that are open, each with the depth of its element,
and notes which anchors (or elements) the last step chooses. Selectors are never
collected and no expression is made for one, so a configuration may hold as many
as it likes; one that is not supported is a fault of its own row.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courant.functions.html import _ANCHOR, _pieces, anchor_of, anchors, count_selected, without_code
from courant.functions.urls import let

# The two forms of a step: tag, .class, #id or a tag with one of them; part of a class or an id.
_SIMPLE = r"(?U)^([A-Za-z][A-Za-z0-9]*)?(?:([.#])([\w-]+))?\z"
_PARTIAL = r"(?U)^\[(class|id)\*='([\w-]+)'\]\z"
_DEFAULT = "a"


def _parts(selector: Column) -> Column:
    shown = F.when(F.trim(F.coalesce(selector, F.lit(""))) == "", _DEFAULT).otherwise(selector)
    return F.filter(F.split(shown, r"\s+"), lambda p: p != "")


def selector_fault(selector: Column) -> Column:
    """What is wrong with a selector, or null."""
    bad = F.filter(_parts(selector), lambda p: ~p.rlike(_SIMPLE) & ~p.rlike(_PARTIAL))
    return F.when(F.size(bad) > 0, F.concat(F.lit("selector not supported: "), F.get(bad, F.lit(0))))


def _steps(selector: Column) -> Column:
    """array<struct(tag, attr, value, partial)>; empty texts where a step does not say."""

    def step(p: Column) -> Column:
        partial = p.rlike(_PARTIAL)
        kind = F.regexp_extract(p, _SIMPLE, 2)
        return F.struct(
            F.lower(F.regexp_extract(p, _SIMPLE, 1)).alias("tag"),
            F.when(partial, F.regexp_extract(p, _PARTIAL, 1)).when(kind == ".", "class").when(kind == "#", "id")
            .otherwise("").alias("attr"),
            F.when(partial, F.regexp_extract(p, _PARTIAL, 2)).otherwise(F.regexp_extract(p, _SIMPLE, 3)).alias("value"),
            partial.alias("partial"),
        )

    return F.transform(_parts(selector), step)


def _tags(html: Column) -> Column:
    """array<struct(name, opens, text)> of all tags; `text` is an opening tag up to its first `>`."""
    return F.transform(_pieces(html, "</?[A-Za-z]"), lambda p: F.struct(
        F.lower(F.regexp_extract(p, r"^</?([A-Za-z][A-Za-z0-9]*)(?=[\s>/])", 1)).alias("name"),
        (~F.startswith(p, F.lit("</"))).alias("opens"), F.substring_index(p, ">", 1).alias("text"),
    ))


def _value(tag: Column, name: str) -> Column:
    quoted = F.regexp_extract(tag, rf"""\s(?i:{name})\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", 1)
    return F.regexp_replace(quoted, r"""^["']|["']$""", "")


def _matches(step: Column, tag: Column) -> Column:
    found = (
        F.when(step["attr"] == "", True)
        .when(step["partial"], F.contains(
            F.when(step["attr"] == "id", _value(tag["text"], "id")).otherwise(_value(tag["text"], "class")), step["value"]))
        .when(step["attr"] == "id", _value(tag["text"], "id") == step["value"])
        .otherwise(F.array_contains(F.split(_value(tag["text"], "class"), r"\s+"), step["value"]))
    )
    return tag["opens"] & ((step["tag"] == "") | (step["tag"] == tag["name"])) & found


def _fold(tags: Column, steps: Column, blocks: Column, chooses) -> Column:
    """Numbers of the tags chosen, among those that `chooses` counts.

    The first `blocks` steps open elements inside each other; an element ends at
    its balanced end tag, and with it all that is open inside. `chooses(tag,
    within, around)` gives (counts, chosen) of a tag: whether all blocks are open
    before it, and with it.
    """

    def step(state: Column, tag: Column) -> Column:
        turn = F.when(tag["opens"], 1).otherwise(-1)
        moved = F.transform(state["open"], lambda o: F.struct(
            o["name"].alias("name"), (o["depth"] + F.when(o["name"] == tag["name"], turn).otherwise(0)).alias("depth")))

        def after(open_: Column) -> Column:
            ended = F.array_position(open_["depth"], 0)
            within = F.when(ended > 0, F.slice(open_, F.lit(1), (ended - 1).cast("int"))).otherwise(open_)

            def opened(now: Column) -> Column:
                goes_in = (F.size(now) < blocks) & (ended == 0) & _matches(F.get(steps, F.size(now)), tag)
                new = F.struct(tag["name"].alias("name"), F.lit(1).alias("depth"))
                around = F.when(goes_in, F.concat(now, F.array(new))).otherwise(now)
                counts, chosen = chooses(tag, F.size(now) == blocks, goes_in & (F.size(now) + 1 == blocks))
                return F.struct(
                    around.alias("open"), (state["seen"] + counts.cast("int")).alias("seen"),
                    F.when(counts & chosen, F.array_append(state["taken"], state["seen"])).otherwise(state["taken"]).alias("taken"),
                )

            return let(within, opened)

        return let(moved, after)

    start = F.struct(
        F.array().cast("array<struct<name:string,depth:int>>").alias("open"), F.lit(0).alias("seen"),
        F.array().cast("array<int>").alias("taken"),
    )
    return F.aggregate(tags, start, step, lambda s: s["taken"])


def own_anchors(html: Column, selector: Column) -> Column:
    """As `anchors`, for the selector each row names; null where it is not supported."""

    def chosen(page: Column) -> Column:
        def by_steps(steps: Column) -> Column:
            last = F.element_at(steps, -1)
            direct = last["tag"] == "a"
            taken = _fold(
                _tags(page), steps, F.size(steps) - direct.cast("int"),
                lambda tag, within, opens_last: (
                    tag["opens"] & (tag["name"] == "a"),
                    F.when(direct, within & _matches(last, tag)).otherwise(within | opens_last),
                ),
            )
            return let(_pieces(page, _ANCHOR), lambda every: F.transform(taken, lambda i: anchor_of(F.get(every, i))))

        return let(_steps(selector), by_steps)

    default = F.trim(F.coalesce(selector, F.lit(""))).isin("", _DEFAULT)
    return F.when(default, anchors(html)).when(selector_fault(selector).isNull(), let(without_code(html), chosen))


def own_count(html: Column, selector: Column) -> Column:
    """As `count_selected`, for the selector each row names; null where it is not supported."""

    def counted(steps: Column) -> Column:
        last = F.element_at(steps, -1)
        return F.size(_fold(
            _tags(without_code(html)), steps, F.size(steps) - 1,
            lambda tag, within, opens_last: (tag["opens"], within & _matches(last, tag)),
        ))

    default = F.trim(F.coalesce(selector, F.lit(""))).isin("", _DEFAULT)
    return F.when(default, count_selected(html)).when(
        selector_fault(selector).isNull() & html.isNotNull(), let(_steps(selector), counted))
