"""Result types of the catalogue: large numbers stay as they are."""

import math
from decimal import Decimal

from gleaner.catalog.registry import portable


def test_large_numbers(spark):
    big = 3.5e16
    rows = [(big, Decimal("35000000000000000.25")), (-big, Decimal("1.25")), (1.00005, None),
            (-2.34567, Decimal("0")), (math.inf, Decimal("922337203685478.5")), (9.1e14 + 0.125, None)]
    got = portable(spark.createDataFrame(rows, "x double, d decimal(38,2)")).collect()
    assert [r.x for r in got] == [big, -big, 1.0001, -2.3457, math.inf, 9.1e14 + 0.125]
    assert [r.d for r in got] == [3.5e16, 1.25, None, 0.0, 922337203685478.5, None]
