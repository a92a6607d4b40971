"""How numbers and times are shown in reports."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def two_digits(number: Column) -> Column:
    return F.when(F.isnan(number), "nan").otherwise(F.format_string("%.2f", number))


def direction(change: Column) -> Column:
    """up, down or flat; an unknown change is flat."""
    return (
        F.when(F.isnan(change), "flat").when(change > 0, "up").when(change < 0, "down").otherwise("flat")
    )


def signed_pct(change: Column) -> Column:
    plus = F.when(direction(change) == "up", "+").otherwise("")
    return F.concat(plus, two_digits(change), F.lit("%"))


def quote_display(quotes):
    """Quotes with the texts a report shows for them."""
    return quotes.withColumns({
        "price_text": two_digits(F.col("price")),
        "change_text": signed_pct(F.col("change_pct")),
        "direction": direction(F.col("change_pct")),
        "time_text": F.date_format("quoted_at", "HH:mm:ss"),
    })
