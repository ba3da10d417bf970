"""Display rounding and text of numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Values are snapped to this decimal type before they are rounded, so that a tie
# such as 2.665 is a tie whatever the last bits of the double.
_SNAP = "decimal(38,8)"


def round_half_even(x: str, digits: int) -> Column:
    """Half-even rounding on the decimal text: 2.675 -> 2.68 and 2.665 -> 2.66."""
    return F.expr(f"cast(bround(cast({x} AS {_SNAP}), {digits}) AS double)")


def percentage(part: str, whole: str) -> Column:
    return round_half_even(f"{part} * 100D / {whole}", 1)


def number_text(x: str) -> Column:
    """Rounded to one decimal, without a trailing zero: 1468.0 -> '1468', 4.2 -> '4.2'."""
    return F.expr(f"replace(cast(bround(cast({x} AS {_SNAP}), 1) AS string), '.0', '')")


def mean_median_text(mean: str, median: str, n: str) -> Column:
    """'mean (median) n=count', with NaN and NA for a cell without any value."""
    return F.concat(
        F.coalesce(number_text(mean), F.lit("NaN")),
        F.lit(" ("),
        F.coalesce(number_text(median), F.lit("NA")),
        F.lit(") n="),
        F.col(n).cast("string"),
    )


def round_significant(x: str, digits: int = 6) -> Column:
    """Half-even rounding to significant digits; a negative zero becomes zero."""
    exponent = f"cast(floor(log10(abs({x}))) AS int)"
    mantissa = f"bround(cast({x} / power(10D, {exponent}) AS decimal(38,10)), {digits - 1})"
    return F.expr(
        f"CASE WHEN {x} = 0 THEN 0D ELSE cast(concat({mantissa}, 'e', {exponent}) AS double) END"
    )
