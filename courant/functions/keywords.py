"""The keyword language: `+must`, `!must-not`, and plain bonus words."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEUTRAL = 0.5


def parse_keywords(text: Column) -> Column:
    """Split a keyword text into a struct of three word lists, lower-cased.

    A bare `+` or `!` gives the empty word, which every text contains.
    """
    words = F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)[\s\x1c-\x1f]+"), lambda w: w != "")

    def marked(sign: str) -> Column:
        chosen = F.filter(words, lambda w: F.startswith(w, F.lit(sign)))
        return F.transform(chosen, lambda w: F.lower(F.substring(w, 2, 2147483647)))

    plain = F.filter(
        words, lambda w: ~F.startswith(w, F.lit("+")) & ~F.startswith(w, F.lit("!"))
    )
    return F.struct(
        marked("+").alias("must"),
        marked("!").alias("must_not"),
        F.transform(plain, F.lower).alias("bonus"),
    )


def keyword_score(title: Column, parsed: Column) -> Column:
    """Source-level score of a title: null when filtered, else 0..1.

    Every must word has to occur and no must-not word may. With bonus words the
    score is the share found, otherwise neutral. No keywords at all is neutral.
    """
    low = F.lower(title)
    must, must_not, bonus = parsed["must"], parsed["must_not"], parsed["bonus"]
    passes = F.forall(must, lambda w: F.contains(low, w)) & ~F.exists(
        must_not, lambda w: F.contains(low, w)
    )
    hits = F.size(F.filter(bonus, lambda w: F.contains(low, w)))
    share = F.when(F.size(bonus) > 0, hits / F.size(bonus)).otherwise(F.lit(NEUTRAL))
    return F.when(parsed.isNull(), F.lit(NEUTRAL)).when(passes, share)


def industry_match(text: Column, parsed: Column) -> Column:
    """Industry-level filter: no must-not word, and any must word if there are some."""
    low = F.lower(text)
    must, must_not = parsed["must"], parsed["must_not"]
    hit = (F.size(must) == 0) | F.exists(must, lambda w: F.contains(low, w))
    blocked = F.exists(must_not, lambda w: F.contains(low, w))
    return F.coalesce(hit & ~blocked, F.lit(True))
