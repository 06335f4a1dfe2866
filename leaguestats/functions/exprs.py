"""Scalar building blocks shared by every operator.

All of them are plain Column expressions, so they stay inside whole-stage
code generation and can be pushed around by the optimizer.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def ratio(numerator: Column, denominator: Column, inf_on_zero: bool = False) -> Column:
    """``numerator / denominator`` as double, NULL when the denominator is zero.

    With ``inf_on_zero`` a non-zero numerator over zero gives a signed infinity
    instead; zero over zero stays NULL.
    """
    n, d = numerator.cast("double"), denominator.cast("double")
    quotient = F.try_divide(n, d)
    if not inf_on_zero:
        return quotient
    return (
        F.when((d == 0) & (n > 0), F.lit(float("inf")))
        .when((d == 0) & (n < 0), F.lit(float("-inf")))
        .otherwise(quotient)
    )


def np_round(c: Column, digits: int) -> Column:
    """Round half to even on the scaled value, the way NumPy does it."""
    scale = F.lit(float(10**digits))
    return F.rint(c * scale) / scale


def no_nan(c: Column) -> Column:
    """NaN to NULL; NaN would sort above everything and poison aggregates."""
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def finite(c: Column) -> Column:
    """NaN and infinities to NULL."""
    value = no_nan(c)
    return F.when(F.abs(value) < float("inf"), value)


def innings_to_decimal(c: Column) -> Column:
    """Baseball innings notation (5.1 is five and one third) to decimal, 2 places."""
    value = c.cast("double")
    whole = F.when(value < 0, F.ceil(value)).otherwise(F.floor(value))
    return np_round(whole + (value % 1.0) * 10.0 / 3.0, 2)


def repair_innings(c: Column) -> Column:
    """Lift summed innings ending in .98 or .99 to the next whole inning.

    Three thirds add up to .99 once each was rounded to two places.  The
    tolerance is the usual absolute-plus-relative closeness test around .99.
    """
    close = F.abs(c % 1.0 - 0.99) <= 0.01 + 1e-5 * 0.99
    return F.when(close, F.ceil(c).cast("double")).otherwise(c)


def format_stat(c: Column) -> Column:
    """Whole numbers without decimals, everything else with three.

    ``format_number`` rounds on the exact binary value (half to even), which is
    what C-style ``%.3f`` does; ``format_string`` would round the decimal text.
    """
    value = c.cast("double")
    pattern = F.when(value == F.rint(value), F.lit("0")).otherwise(F.lit("0.000"))
    return F.call_function("format_number", value, pattern)


def plain_number(c: Column) -> Column:
    """A fraction as text without an exponent: 12345678.0, 0.0005."""
    text = c.cast("string")
    digits = F.regexp_replace(text.try_cast("decimal(38,18)").cast("string"), "0+$", "")
    spelled = F.when(F.endswith(digits, F.lit(".")), F.concat(digits, F.lit("0"))).otherwise(digits)
    return F.when(F.contains(text, F.lit("E")), F.coalesce(spelled, text)).otherwise(text)


def lookup(c: Column, mapping: dict[str, str], keep_unknown: bool = False) -> Column:
    """Translate a string through a small fixed dictionary.

    Unknown values become NULL, or stay as they are with ``keep_unknown``.  For
    a dictionary that lives in a table use ``operators.totals.add_dimension``.
    """
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    if not pairs:
        return c if keep_unknown else F.lit(None).cast("string")
    found = F.try_element_at(F.create_map(*pairs), c)
    return F.coalesce(found, c) if keep_unknown else found
