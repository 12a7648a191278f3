"""Column functions that format numbers for report columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, functions as F

from context_shaper import fixed_values as V


def round_half_up(value: Column) -> Column:
    """floor(x + 0.5) as a BIGINT."""
    return F.floor(value + F.lit(0.5)).cast("bigint")


def to_fixed(value: Column, digits: int) -> Column:
    """Fixed decimals of a non-negative double; exact binary ties go up.

    ``format_number`` rounds the exact binary value and sends ties to the even digit.  A tie
    exists only when ``value * 2**(digits + 1)`` is an odd integer, and then a nudge settles it.
    """
    value = value.cast("double")
    scaled = value * F.lit(float(2 ** (digits + 1)))
    tie = (scaled == F.floor(scaled)) & (F.floor(scaled) % 2 == 1)
    nudged = F.when(tie, value + F.lit(0.25 * 10.0**-digits)).otherwise(value)
    usual = F.replace(F.format_number(nudged, digits), F.lit(","), F.lit(""))
    # Below one last-place unit the answer is that unit or zero; format_number is not exact there.
    unit, half = Decimal(1).scaleb(-digits), Decimal(5).scaleb(-digits - 1)
    nearest = F.lit(float(half))
    reaches = value >= nearest if Decimal(float(half)) >= half else value > nearest
    small = F.when(reaches, str(unit)).otherwise(str(Decimal(0).scaleb(-digits)))
    return F.when(value < F.lit(float(unit)), small).otherwise(usual)


def format_tokens(tokens: Column) -> Column:
    number = tokens.cast("double")
    return (
        F.when(number >= 1e6, F.concat(to_fixed(number / F.lit(1e6), 1), F.lit("M")))
        .when(
            number >= 1e4,
            F.concat(round_half_up(number / F.lit(1e3)).cast("string"), F.lit("k")),
        )
        .when(number >= 1e3, F.concat(to_fixed(number / F.lit(1e3), 1), F.lit("k")))
        .otherwise(tokens.cast("bigint").cast("string"))
    )


def format_usd(amount: Column) -> Column:
    text = (
        F.when(amount >= 1, to_fixed(amount, 2))
        .when(amount >= 0.01, to_fixed(amount, 3))
        .otherwise(to_fixed(amount, 4))
    )
    return F.concat(F.lit("$"), text)


def percent_of(part: Column, whole: Column) -> Column:
    """Whole percent; 0 when there is nothing to divide by."""
    share = part.cast("double") / whole.cast("double") * F.lit(100.0)
    return F.when(whole > 0, round_half_up(share)).otherwise(F.lit(0)).cast("bigint")


def share_bar(share: Column, width: int = V.BAR_WIDTH) -> Column:
    filled = round_half_up(share * F.lit(float(width))).cast("int")
    return F.rpad(F.repeat(F.lit("█"), filled), width, "░")


def fill_template(template: str, *values: Column) -> Column:
    """A ``%s`` template (``%%`` for a percent sign) as one concat of string columns."""
    parts = template.split("%s")
    pieces = [F.lit(parts[0].replace("%%", "%"))]
    for value, text in zip(values, parts[1:], strict=True):
        pieces += [value.cast("string"), F.lit(text.replace("%%", "%"))]
    return F.concat(*pieces)
