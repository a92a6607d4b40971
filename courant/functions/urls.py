"""URL expressions: joining a reference to its page, and safety checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_END = 2147483647


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate `value` once and use it several times in `body`."""
    return F.transform(F.array(value), body)[0]


def url_path(url: Column) -> Column:
    """Path of an absolute url, without query, fragment and trailing parameters."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*:(?://[^/?#]*)?([^?#]*)", 1)
    return F.regexp_replace(path, r";[^/]*$", "")


def url_scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))


def _resolve_dots(segments: Column) -> Column:
    """Apply `.` and `..` segments and put the path together again."""

    def step(done: Column, seg: Column) -> Column:
        return (
            F.when(seg == ".", done)
            .when(seg == "..", F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0))))
            .otherwise(F.array_append(done, seg))
        )

    empty = F.array().cast("array<string>")
    kept = F.aggregate(segments, empty, step)
    ends_open = F.element_at(segments, -1).isin(".", "..")
    path = F.array_join(F.when(ends_open, F.array_append(kept, F.lit(""))).otherwise(kept), "/")
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.lit("/"), path))


def _drop_empty_middle(segments: Column) -> Column:
    last = F.size(segments) - 1
    return F.filter(segments, lambda s, i: (i == 0) | (i == last) | (s != ""))


def _clean_path(path: Column, relative: bool) -> Column:
    """A path without dot segments; most have none and are left alone."""
    untidy = F.contains(path, F.lit("/."))
    segments = F.split(path, "/")
    if relative:
        untidy = untidy | F.contains(path, F.lit("//"))
        segments = _drop_empty_middle(segments)
    return F.when(untidy, _resolve_dots(segments)).otherwise(path)


def split_base(base: Column) -> Column:
    """The parts of a page's url that references on it are joined to."""
    pattern = r"^([^:/?#]+)://([^/?#]*)([^?#]*)(\?[^#]+)?"
    scheme, place, path, query = (F.regexp_extract(base, pattern, i) for i in (1, 2, 3, 4))
    folder = F.regexp_replace(path, r"[^/]*$", "")
    return F.struct(
        F.lower(scheme).alias("scheme"),
        F.concat(F.lower(scheme), F.lit("://"), place).alias("site"),
        path.alias("path"), query.alias("query"),
        F.when(folder == "", F.lit("/")).otherwise(folder).alias("folder"),
    )


def join_parts(base: Column, ref: Column) -> Column:
    """The absolute form of `ref`, given the parts of the page's url (RFC 3986)."""

    def resolve(parts: Column) -> Column:
        ref_, own, rest = parts["ref"], parts["scheme"], parts["rest"]
        path, query = parts["path"], parts["query"]
        same_page = F.concat(
            base["site"], base["path"],
            F.when(F.startswith(query, F.lit("?")), query).otherwise(F.concat(base["query"], query)),
        )
        relative = F.concat(base["folder"], path)
        return (
            F.when((own != "") & (own != base["scheme"]), ref_)
            .when(F.startswith(rest, F.lit("//")), F.concat(base["scheme"], F.lit(":"), path, query))
            .when(path == "", same_page)
            .when(
                F.startswith(path, F.lit("/")),
                F.concat(base["site"], _clean_path(path, False), query),
            )
            .otherwise(F.concat(base["site"], _clean_path(relative, True), query))
        )

    def split(parts: Column) -> Column:
        ref_, own = parts["ref"], parts["scheme"]
        # `http:x` on an http page is the relative reference `x`.
        rest = F.when(own == base["scheme"], F.regexp_replace(ref_, r"^[^:]*:", "")).otherwise(ref_)
        tail = F.regexp_extract(rest, r"^[^?#]*((?s:.*))$", 1)
        return F.struct(
            ref_.alias("ref"), own.alias("scheme"), rest.alias("rest"),
            F.regexp_extract(rest, r"^([^?#]*)", 1).alias("path"),
            F.regexp_replace(tail, r"^\?(?=#|$)|#$", "").alias("query"),
        )

    clean = F.translate(ref, "\t\r\n", "")
    opened = let(clean, lambda r: F.struct(r.alias("ref"), url_scheme(r).alias("scheme")))
    return let(let(opened, split), resolve)


def join_url(base: Column, ref: Column) -> Column:
    """The absolute form of `ref` as found on the page `base`."""
    return let(split_base(base), lambda b: join_parts(b, ref))
