"""Display-text column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..fixed import ELLIPSIS, JOB_ID_LABEL, NO_AMOUNT, NO_NUMBER, RUN_LABEL, RUN_NAME_CHARS


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


#: Any character that is no white space (tabs and line ends included).
NOT_BLANK = r"[^\s\u00a0\u2000-\u200a\u3000\u0085\u2028\u2029\x1c-\x1f]"


def display_name(name, job_id) -> Column:
    """The name when it has non-blank text, else ``Job ID: <id>``."""
    n = _col(name)
    blank = ~F.coalesce(n.rlike(NOT_BLANK), F.lit(False))
    return F.when(blank, F.concat(F.lit(JOB_ID_LABEL), _col(job_id).cast("string"))).otherwise(n)


def run_label(name, run_id) -> Column:
    """First 20 characters of the name plus ``...``, else ``Run <id>``."""
    n = _col(name)
    blank = ~F.coalesce(n.rlike(NOT_BLANK), F.lit(False))
    return F.when(blank, F.concat(F.lit(RUN_LABEL), _col(run_id).cast("string"))) \
        .otherwise(F.concat(F.substring(n, 1, RUN_NAME_CHARS), F.lit(ELLIPSIS)))


#: Doubles from here on are whole numbers and printed digit by digit.
WHOLE = float(1 << 62)


def fixed_point(v: Column, places: int) -> Column:
    """Size of a double below ``WHOLE``, rounded to up to two places as a fixed-point format does:
    its exact value, half to even.

    The fraction is a whole number of 2**-62 (all bits that can decide a half),
    so quotient and remainder of that number decide, and no decimal text of the double.
    """
    size, unit = F.when(F.abs(v) < WHOLE, F.abs(v)), F.lit(1 << 62).cast("decimal(38,0)")
    whole = F.floor(size)
    scaled = ((size - whole) * WHOLE).cast("long").cast("decimal(38,0)") * F.lit(10**places).cast("decimal(3,0)")
    quotient = F.floor(scaled / unit).cast("decimal(10,0)")
    rest = (scaled - quotient * unit) * 2
    up = (rest > unit) | ((rest == unit) & (quotient % 2 == 1))
    steps = (quotient + up.cast("int")).cast("decimal(10,0)") / F.lit(10**places).cast("decimal(3,0)")
    return (whole.cast("decimal(20,0)") + steps).cast(f"decimal(30,{places})")


def _carry(limbs: Column) -> Column:
    """Limbs of nine decimal digits, lowest first, made proper after a multiplication."""
    step = F.aggregate(limbs, F.struct(F.array().cast("array<bigint>").alias("done"), F.lit(0).cast("bigint").alias("over")),
                       lambda acc, x: F.struct(F.array_append(acc["done"], (x + acc["over"]) % 1_000_000_000).alias("done"),
                                               F.floor((x + acc["over"]) / F.lit(1_000_000_000).cast("decimal(10,0)")).cast("bigint").alias("over")),
                       lambda acc: F.when(acc["over"] > 0, F.array_append(acc["done"], acc["over"])).otherwise(acc["done"]))
    return step


def whole_digits(v: Column) -> Column:
    """All digits of the size of a double from ``WHOLE`` on: the mantissa doubled as often as its exponent says,
    28 doublings at a time, in limbs of nine digits."""
    size = F.abs(v)
    exponent = F.floor(F.log2(size)).cast("int")
    # one doubling less than 52 bits need, as log2 may round up to the next whole number: 53 or 54 bits, no fraction
    doublings = exponent - 53
    mantissa = (size / F.pow(F.lit(2.0), doublings)).cast("bigint")
    start = F.array((mantissa % 1_000_000_000), F.floor(mantissa / F.lit(1_000_000_000).cast("decimal(10,0)")).cast("bigint"))
    steps = F.transform(F.sequence(F.lit(0), F.ceil(doublings / 28).cast("int") - 1),
                        lambda i: F.pow(F.lit(2.0), F.least(F.lit(28), doublings - 28 * i)).cast("bigint"))
    limbs = F.aggregate(steps, _carry(start), lambda acc, by: _carry(F.transform(acc, lambda x: x * by)))
    text = F.array_join(F.transform(F.reverse(limbs), lambda x: F.lpad(x.cast("string"), 9, "0")), "")
    return F.when(size >= WHOLE, F.ltrim(text, F.lit("0")))


def _grouped(digits: Column) -> Column:
    """Digits with a comma before every third one from the right."""
    return F.regexp_replace(digits, r"(?<=\d)(?=(?:\d{3})+$)", ",")


def _sign(v: Column) -> Column:
    # the sign of a negative zero counts
    return F.when((v < 0) | ((v == 0) & F.startswith(v.cast("string"), F.lit("-"))), F.lit("-")).otherwise(F.lit(""))


def _size_text(v: Column, places: int, comma: bool) -> Column:
    """Size of a double with ``places`` decimals: any finite number, or ``inf``."""
    small = fixed_point(v, places)
    low = F.format_number(small, places) if comma else small.cast("string")
    digits = whole_digits(v)
    high = F.concat(_grouped(digits) if comma else digits, F.lit("." + "0" * places))
    return F.when(F.abs(v) == float("inf"), F.lit("inf")).when(F.abs(v) < WHOLE, low).otherwise(high)


def format_currency(x) -> Column:
    """``$1,234.57``, a negative amount as ``$-12.34``; NULL and NaN -> ``$0.00``."""
    v = _col(x).cast("double")
    text = F.concat(F.lit("$"), _sign(v), _size_text(v, 2, True))
    return F.when(v.isNull() | F.isnan(v), F.lit(NO_AMOUNT)).otherwise(text)


def format_large_number(x) -> Column:
    """``1.2M`` / ``3.4K`` / ``5.6``; NULL and NaN -> ``0``."""
    v = _col(x).cast("double")

    def one_decimal(c):
        return F.concat(_sign(c), _size_text(c, 1, False))

    return (F.when(v.isNull() | F.isnan(v), F.lit(NO_NUMBER))
            .when(v >= 1_000_000, F.concat(one_decimal(v / 1_000_000), F.lit("M")))
            .when(v >= 1_000, F.concat(one_decimal(v / 1_000), F.lit("K")))
            .otherwise(one_decimal(v)))


def format_money_columns(df: DataFrame) -> DataFrame:
    """Render every column whose name mentions cost or price as currency."""
    cols = [c for c in df.columns if "cost" in c.lower() or "price" in c.lower()]
    return df.withColumns({c: format_currency(c) for c in cols}) if cols else df
