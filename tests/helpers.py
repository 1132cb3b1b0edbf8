"""Small snapshot tables built from values."""

from __future__ import annotations

import math
from datetime import datetime, timedelta, timezone

from pyspark.sql import types as T

from tapeloom.schemas import COUNTS, LIMITS, PRICES

TEHRAN = timezone(timedelta(hours=3, minutes=30))
SCHEMA = T.StructType(
    [T.StructField("seq", T.LongType()), T.StructField("ins_code", T.StringType()), T.StructField("symbol", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("source_time", T.TimestampType()), T.StructField("ingest_time", T.TimestampType()),
     T.StructField("source_time_estimated", T.BooleanType())]
    + [T.StructField(n, T.LongType()) for n in PRICES + LIMITS + COUNTS]
    + [T.StructField("missing", T.ArrayType(T.StringType())), T.StructField("class", T.StringType())])


def at(day: str, hms: str) -> datetime:
    return datetime.fromisoformat(f"{day}T{hms}").replace(tzinfo=TEHRAN)


def snap(ins: str, when: datetime, price: int, vol: int, ind_buy: int, ind_sell: int, buy_n: int, sell_n: int, cls: str = "stock", **over) -> dict:
    """A consistent snapshot: every share bought is sold. ``missing`` fields become NULL."""
    row = {
        "ins_code": ins, "symbol": "S", "source": "test", "source_time": when, "ingest_time": when + timedelta(seconds=1), "source_time_estimated": False,
        **{n: 0 for n in PRICES + COUNTS}, **{n: None for n in LIMITS}, "price_last": price, "volume": vol, "value": vol * price, "ind_buy_vol": ind_buy, "inst_buy_vol": vol - ind_buy,
        "ind_sell_vol": ind_sell, "inst_sell_vol": vol - ind_sell, "ind_buy_count": buy_n, "ind_sell_count": sell_n, "missing": [], "class": cls}
    row.update(over)
    for name in row["missing"]:
        row[name] = None
    return row


def table(spark, rows: list[dict]):
    """Rows in the order they were received."""
    ordered = sorted(rows, key=lambda r: r["ingest_time"])
    data = [tuple({**r, "seq": i}[f.name] for f in SCHEMA.fields) for i, r in enumerate(ordered)]
    return spark.createDataFrame(data, SCHEMA)


def upper_tail(t: float, dof: float) -> float:
    """P(T > t) of Student's t by the continued fraction of the incomplete beta function: one number, to check the expression against."""
    x = dof / (dof + t * t)
    a, b = dof / 2.0, 0.5
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) if 0 < x < 1 else 0.0

    def fraction(a: float, b: float, x: float) -> float:
        c, d = 1.0, 1.0 - (a + b) * x / (a + 1)
        d = 1.0 / (d or 1e-300)
        f = d
        for m in range(1, 300):
            for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
                d = 1.0 / ((1.0 + num * d) or 1e-300)
                c = (1.0 + num / c) or 1e-300
                f *= c * d
            if abs(c * d - 1.0) < 1e-14:
                break
        return f

    both = front * fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1.0 - front * fraction(b, a, 1 - x) / b
    if x >= 1.0:
        both = 1.0
    return both / 2 if t > 0 else 1 - both / 2
