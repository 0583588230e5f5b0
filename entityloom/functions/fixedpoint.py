"""Order-independent statistics on scaled whole numbers ("units").

A number is turned once per row into ``round(x * 10^scale)``: a BIGINT column
stays one, anything else becomes a whole-numbered double, so no size of value is
refused. Sums are added up in limbs that cannot overflow and are put together
once per group:

* units up to 2^31 go to one BIGINT sum, which holds 2^32 of the largest;
* larger ones are cut at bit 31: low limbs go to the same BIGINT sum, high limbs to
  a sum of doubles. High limbs are whole numbers, so their sum is exact while it stays below 2^84 units; beyond that it is rounded like any double sum.

A square of units up to 2^31 is cut at bit 31 as well. Larger ones up to 2^53 go
to a DECIMAL sum, which becomes missing, in ANSI mode too, rather than wrong;
with still larger ones among the rows, or where it is missing, the variance comes
from sums of doubles. A 32-bit column needs the first limbs only.

All functions but ``to_units`` take and return SQL text over named columns.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Units of up to so many bits are common: two of them fit BIGINT as a product.
COMMON_BITS = 31
LIMB = 1 << COMMON_BITS
#: Doubles hold all whole numbers up to here.
EXACT = 1 << 53
WIDE = "decimal(38,0)"


def to_units(value: Column, scale: int) -> Column:
    """Scaled whole number of a finite double (half-even), missing stays missing.

    A value so large that its scaled number leaves the range of doubles is
    infinite, as it would be in a sum of doubles.
    """
    number = value.cast("double")
    return F.rint(number if scale == 0 else number * F.lit(10.0**scale))


def power(scale: int) -> str:
    return f"{10.0**scale:.1f}D"


def from_units(units: str, scale: int) -> str:
    return f"cast({units} AS double) / {power(scale)}"


def _common(units: str) -> str:
    return f"{units} BETWEEN -{LIMB}L AND {LIMB}L"


def limbs(units: str, kind: str = "double") -> tuple[str, str]:
    """Common units or the low limb of larger ones, and the high limb of larger ones.

    ``kind`` is the type of the column: ``int``, ``long`` or ``double``; an int
    has no high limb.
    """
    if kind == "int":
        return f"cast({units} AS bigint)", "NULL"
    if kind == "long":
        high, low = f"cast(shiftright({units}, {COMMON_BITS}) AS double)", f"{units} & {LIMB - 1}L"
    else:
        high = f"rint({units} / {LIMB}.0D)"
        low = f"cast({units} - {high} * {LIMB}.0D AS bigint)"
    return (
        f"CASE WHEN {_common(units)} THEN cast({units} AS bigint) ELSE {low} END",
        f"CASE WHEN {_common(units)} THEN NULL ELSE {high} END",
    )


def sums(low: str, high: str) -> dict[str, str]:
    """Aggregates of both limbs whose combination is the sum."""
    return {"s": f"sum({low})"} | ({} if high == "NULL" else {"wh": f"sum({high})"})


def exact_total(s: str, wh: str = "NULL") -> str:
    """The sum as DECIMAL(30,0); missing without a value, and beyond 2^97 units."""
    if wh == "NULL":
        return f"cast({s} AS decimal(30,0))"
    high = f"try_cast(coalesce({wh}, 0.0D) AS decimal(19,0)) * cast({LIMB} AS decimal(10,0))"
    return f"try_cast(cast({s} AS decimal(20,0)) + {high} AS decimal(30,0))"


def total(s: str, wh: str = "NULL", exact: str | None = None) -> str:
    """The sum as a double, missing when there was nothing to add."""
    exact = f"cast({exact or exact_total(s, wh)} AS double)"
    if wh == "NULL":
        return exact
    return f"coalesce({exact}, {wh} * {LIMB}.0D + cast({s} AS double))"


def exact_sum(units: str) -> str:
    """The same in one text of aggregates."""
    return f"({total(*sums(*limbs(units)).values())})"


def square_sums(units: str, low: str, high: str) -> dict[str, str]:
    """Aggregates of units and their limbs whose combination is the sum of squares."""
    square = f"{low} * {low}" if high == "NULL" else f"CASE WHEN {high} IS NULL THEN {low} * {low} END"
    parts = {
        "hi": f"sum(shiftright({square}, {COMMON_BITS}))",
        "lo": f"sum(({square}) & {LIMB - 1}L)",
    }
    if high == "NULL":
        return parts
    wide, plain = f"cast({units} AS decimal(16,0))", f"cast({units} AS double)"
    return {
        **parts,
        "ssw": f"try_sum(CASE WHEN {high} BETWEEN -{EXACT // LIMB} AND {EXACT // LIMB} THEN {wide} * {wide} END)",
        "ssd": f"sum(CASE WHEN {high} IS NOT NULL THEN {plain} * {plain} END)",
    }


def _limbs(hi: str, lo: str) -> str:
    high = f"cast(coalesce({hi}, 0L) AS decimal(20,0)) * cast({LIMB} AS decimal(10,0))"
    return f"({high} + cast(coalesce({lo}, 0L) AS decimal(20,0)))"


def exact_squares(hi: str, lo: str, ssw: str = "NULL", ssd: str = "NULL") -> str:
    """Sum of squares as DECIMAL(38,0); missing where a square was too large for it.

    A square above 2^106 is at least 2^-20 of all squares that DECIMAL can hold,
    which shows in the sum of doubles.
    """
    if ssd == "NULL":
        return f"cast({_limbs(hi, lo)} AS {WIDE})"
    whole = f"{ssd} IS NULL OR abs({ssd} - cast({ssw} AS double)) <= {ssd} * {2.0**-22!r}D"
    return f"CASE WHEN {whole} THEN try_add({_limbs(hi, lo)}, coalesce({ssw}, cast(0 AS {WIDE}))) END"


def combined_squares(
    hi: str, lo: str, ssw: str = "NULL", ssd: str = "NULL", exact: str | None = None
) -> str:
    """Sum of squares as a double, 0 when there was nothing to add."""
    exact = f"cast({exact or exact_squares(hi, lo, ssw, ssd)} AS double)"
    if ssd == "NULL":
        return exact
    return f"coalesce({exact}, cast({_limbs(hi, lo)} AS double) + {ssd})"


def mean(count: str, total: str, scale: int) -> str:
    return f"try_divide(cast({total} AS double), cast({count} AS double) * {power(scale)})"


def sample_variance(count: str, whole: str, squares: str, doubles: tuple[str, str] | None, scale: int) -> str:
    """Sample variance from columns with the exact sum and squares; missing below two values.

    With ``whole = q*n + r`` the centred sum of squares is
    ``squares - q*(whole + r) - r*r/n``; the first two terms stay integers, so
    large values do not cancel. Where an integer is missing, the same comes from
    ``doubles``, sum and sum of squares; a spread beyond their range is missing,
    never 0.
    """
    n = f"cast({count} AS double)"
    q = f"try_cast({whole} div {count} AS decimal(19,0))"
    r = f"cast({whole} % {count} AS decimal(19,0))"
    centre = f"try_multiply({q}, cast({whole} + {r} AS decimal(30,0)))"
    integers = f"try_subtract({squares}, cast({centre} AS {WIDE}))"
    spread = f"cast({integers} AS double) - cast({r} AS double) * cast({r} AS double) / {n}"
    if doubles:
        spread = f"coalesce({spread}, {doubles[1]} - {doubles[0]} * ({doubles[0]} / {n}))"
    at_least_0 = f"nullif(greatest(coalesce({spread}, double('NaN')), 0.0D), double('NaN'))"
    return f"CASE WHEN {count} > 1 THEN {at_least_0} / ({n} - 1.0D) / {power(2 * scale)} END"


def moment_variance(count: str, total: str, squares: str) -> str:
    """Clamped sample variance from plain double statistics ``(n, s, ss)``."""
    n = f"cast({count} AS double)"
    spread = f"coalesce({squares} - {total} * {total} / {n}, double('NaN'))"
    at_least_0 = f"nullif(greatest({spread}, 0.0D), double('NaN'))"
    return f"CASE WHEN {count} > 1 THEN {at_least_0} / ({n} - 1.0D) END"
