"""Money and large-number text over the whole range of doubles, and A6 on scalars."""

import math
import random
import struct

import pytest

from costlens.functions.text import format_currency, format_large_number
from costlens.sources.catalog import query_view


def currency(x):
    return "$0.00" if x is None or math.isnan(x) else f"${x:,.2f}"


def large(x):
    if x is None or math.isnan(x):
        return "0"
    if x >= 1_000_000:
        return f"{x / 1_000_000:.1f}M"
    return f"{x / 1_000:.1f}K" if x >= 1_000 else f"{x:.1f}"


def numbers():
    rng = random.Random(7)
    values = [0.0, -0.0, 0.005, 0.015, 0.125, 2.675, 1e15, 1e19, -1e19, 2.0**62, 2.0**62 - 512, 2.0**63, 2.0**64, 1e22, 1e23,
              1.7976931348623157e308, -1.7976931348623157e308, 5e-324, math.inf, -math.inf, math.nan, None, 999.95, 999999.95, 1e24, 1e25]
    values += [2.0**k for k in range(60, 1024, 37)] + [math.nextafter(2.0**k, 0) for k in range(60, 1024, 53)]
    values += [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(1500)]
    values += [rng.choice([-1, 1]) * rng.uniform(0, 10 ** rng.randint(0, 25)) for _ in range(1000)]
    return values


def test_number_text_of_any_double(spark):
    values = numbers()
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    got = {r["i"]: (r["c"], r["l"]) for r in df.select("i", format_currency("v").alias("c"), format_large_number("v").alias("l")).collect()}
    wrong = [(v, got[i], (currency(v), large(v))) for i, v in enumerate(values) if got[i] != (currency(v), large(v))]
    assert not wrong, wrong[:5]


@pytest.mark.parametrize("filters,ids", [({"s": ""}, [1]), ({"n": 0}, [1, 2]), ({"n": [0], "s": "x"}, [2]), ({"s": None}, [1, 2, 3, 4]),
                                         ({"s": []}, [1, 2, 3, 4]), ({"b": False}, [2])])
def test_scalars_of_a_stored_view_are_compared(spark, filters, ids):
    df = spark.createDataFrame([(1, "", 0, True), (2, "x", 0, False), (3, "x", 5, None), (4, None, None, True)],
                               "id int, s string, n int, b boolean")
    assert sorted(r["id"] for r in query_view(df, filters).collect()) == ids
