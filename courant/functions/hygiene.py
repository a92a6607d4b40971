"""Masking of secrets in text, checks of urls, encryption of a column."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courant.functions.urls import let

_W = r"\p{L}\p{N}_"

# What counts as sensitive, in the order it is masked, each with a
# text any match contains. Word characters are Unicode letters, digits and `_`.
MASKS = (
    (rf"[{_W}.+-]+@[{_W}-]+\.[{_W}.]+", "***@***.***", "@"),
    (rf"(?i)(password['\"]?\s*[:=]\s*)['\"]?[{_W}!@#$%^&*]+['\"]?", "$1***", "password"),
    (rf"(?i)(Authorization:\s*[{_W}]+\s+)[{_W}.=+/-]+", "$1***", "authorization:"),
    (rf"(?i)(api[_-]?key['\"]?\s*[:=]\s*)['\"]?[{_W}\-]+['\"]?", "$1***", "key"),
    (rf"(?i)(token['\"]?\s*[:=]\s*)['\"]?[{_W}\-]+['\"]?", "$1***", "token"),
    (rf"(?i)(secret['\"]?\s*[:=]\s*)['\"]?[{_W}\-]+['\"]?", "$1***", "secret"),
    (rf"(?i)(Bearer\s+)[{_W}\-.=+/]+", "$1***", "bearer"),
    (rf"gAAAAA[{_W}\-=+/]{{20,}}", "gAAAAA***", "gaaaaa"),
)

# Networks no fetch may reach, as (first, last) addresses.
PRIVATE_IPV4 = (
    ("10.0.0.0", "10.255.255.255"),
    ("172.16.0.0", "172.31.255.255"),
    ("192.168.0.0", "192.168.255.255"),
    ("127.0.0.0", "127.255.255.255"),
    ("169.254.0.0", "169.254.255.255"),
)
PRIVATE_IPV6 = (r"^[0:]*:0*1$", r"^f[cd][0-9a-f]{2}:")
SAFE_SCHEMES = ("http", "https")

SEALED = "sealed1:"


def _mask_one(pattern: str, cover: str, part: str) -> Callable[[Column], Column]:
    def masked(state: Column) -> Column:
        hit = F.contains(state["low"], F.lit(part))
        text = F.when(hit, F.regexp_replace(state["text"], pattern, cover)).otherwise(state["text"])
        return F.struct(state["low"].alias("low"), text.alias("text"))

    return masked


def mask(text: Column) -> Column:
    """Mask addresses, passwords, keys and tokens.

    Most texts hold none; a plain search for a part of the match keeps the
    patterns away from them. No cover brings in what another pattern looks for.
    """
    state = F.struct(F.lower(text).alias("low"), text.alias("text"))
    for pattern, cover, part in MASKS:
        state = let(state, _mask_one(pattern, cover, part))
    return state["text"]


def _address(ip: Column) -> Column:
    """An IPv4 literal as a number, null for anything else."""
    pattern = r"^(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})$"
    found = F.transform(
        F.array(*[F.regexp_extract(ip, pattern, i) for i in (1, 2, 3, 4)]),
        lambda part: part.try_cast("bigint"),
    )
    number = F.aggregate(found, F.lit(0).cast("bigint"), lambda n, part: n * 256 + part)
    return F.when(ip.rlike(pattern), let(found, lambda f: F.when(F.array_max(f) <= 255, number)))


def _number(ip: str) -> int:
    value = 0
    for part in ip.split("."):
        value = value * 256 + int(part)
    return value


def is_literal(host: Column) -> Column:
    return _address(host).isNotNull() | F.contains(host, F.lit(":"))


def is_private(ip: Column) -> Column:
    def verdict(parts: Column) -> Column:
        number, low = parts["number"], parts["low"]
        inside = [number.between(_number(first), _number(last)) for first, last in PRIVATE_IPV4]
        listed = [low.rlike(pattern) for pattern in PRIVATE_IPV6]
        return F.coalesce(reduce(or_, inside), F.contains(low, F.lit(":")) & reduce(or_, listed))

    return let(F.struct(_address(ip).alias("number"), F.lower(ip).alias("low")), verdict)


def host_of(url: Column) -> Column:
    """Host of a url in lower case, without user, port and brackets."""
    place = F.regexp_replace(F.regexp_extract(url, r"^[^:/?#]*:?//([^/?#]*)", 1), "^.*@", "")
    return F.lower(F.coalesce(
        F.nullif(F.regexp_extract(place, r"^\[([^\]]*)\]", 1), F.lit("")),
        F.regexp_extract(place, r"^([^:\[]*)", 1),
    ))


def check_urls(urls: DataFrame, resolved: DataFrame, url: str = "url") -> DataFrame:
    """Add `reason` (null when safe) and `is_safe`.

    `resolved` holds the addresses (host, ip) of names; a name missing there is
    unsafe, as one that cannot be looked up. One private address is enough.
    """
    known = resolved.groupBy(F.lower("host").alias("_host")).agg(
        F.max(is_private(F.col("ip"))).alias("_private")
    )
    scheme = F.lower(F.regexp_extract(F.col(url), r"^([A-Za-z][A-Za-z0-9+.\-]*):", 1))
    literal = F.col("_literal")
    reason = (
        F.when(~F.col("_scheme").isin(*SAFE_SCHEMES), "scheme")
        .when(F.col("_host") == "", "no host")
        .when(literal & is_private(F.col("_host")), "private")
        .when(~literal & F.col("_private").isNull(), "unresolved")
        .when(~literal & F.col("_private"), "private")
    )
    return (
        urls.withColumn("_scheme", scheme)
        .withColumn("_host", host_of(F.col(url)))
        .withColumn("_literal", is_literal(F.col("_host")))
        .join(known, "_host", "left")
        .withColumn("reason", reason)
        .withColumn("is_safe", F.col("reason").isNull())
        .drop("_scheme", "_host", "_literal", "_private")
    )


def encrypt(text: Column, key: Column) -> Column:
    """Encrypt a secret, unless it is empty or already encrypted."""
    done = F.startswith(text, F.lit(SEALED)) | F.startswith(text, F.lit("gAAAAA"))
    sealed = F.concat(F.lit(SEALED), F.base64(F.aes_encrypt(text, key, F.lit("GCM"))))
    return F.when((text == "") | done, text).otherwise(sealed)


def decrypt(text: Column, key: Column) -> Column:
    """The secret again; a wrong key fails the query."""
    body = F.unbase64(F.substring(text, len(SEALED) + 1, 2147483647))
    return F.when(
        F.startswith(text, F.lit(SEALED)), F.aes_decrypt(body, key, F.lit("GCM")).cast("string")
    ).otherwise(text)
