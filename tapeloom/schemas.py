"""Fixed schemas of the canonical tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Names of the flow fields every money-flow metric needs.
FLOW_FIELDS = ["price_last", "volume", "value", "ind_buy_vol", "ind_sell_vol", "ind_buy_count", "ind_sell_count"]

# Cumulative day totals compared between two snapshots -> name used in issue texts.
TOTALS = {
    "volume": "volume",
    "value": "value",
    "trade_count": "trades",
    "ind_buy_vol": "ind_buy_vol",
    "ind_sell_vol": "ind_sell_vol",
    "inst_buy_vol": "inst_buy_vol",
    "inst_sell_vol": "inst_sell_vol",
    "ind_buy_count": "ind_buy_count",
    "ind_sell_count": "ind_sell_count",
}

PRICES = ["price_last", "price_close", "price_first", "price_yesterday", "price_min", "price_max"]
LIMITS = ["price_limit_min", "price_limit_max"]
COUNTS = [
    "trade_count", "volume", "value",
    "ind_buy_vol", "ind_sell_vol", "inst_buy_vol", "inst_sell_vol",
    "ind_buy_count", "ind_sell_count", "inst_buy_count", "inst_sell_count",
]

LEVEL = T.StructType([T.StructField(n, T.LongType()) for n in
                      ["BidPrice", "BidVol", "BidCount", "AskPrice", "AskVol", "AskCount"]])

# One observation of one instrument as it travels in JSON (no arrival number).
SNAPSHOT_JSON = T.StructType(
    [T.StructField("ins_code", T.StringType()), T.StructField("symbol", T.StringType()),
     T.StructField("source", T.StringType()), T.StructField("source_time", T.TimestampType()),
     T.StructField("ingest_time", T.TimestampType()), T.StructField("source_time_estimated", T.BooleanType())]
    + [T.StructField(n, T.LongType()) for n in PRICES + LIMITS + COUNTS]
    + [T.StructField("book", T.ArrayType(LEVEL)), T.StructField("missing", T.ArrayType(T.StringType()))]
)

# The canonical table adds ``seq``, the arrival order (a Kafka offset or a number written at ingest).
SNAPSHOT = T.StructType([T.StructField("seq", T.LongType())] + SNAPSHOT_JSON.fields)
