"""Vendor payloads -> vendor rows -> canonical snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.text import elements, num, text, tokens, whole_decimal
from tapeloom.runtime import prepare

# Canonical field -> vendor key, in the order fields are listed as missing.
FEED_A = {
    "price_last": "pl", "price_close": "pc", "price_first": "pf", "price_yesterday": "py", "price_min": "pmin", "price_max": "pmax",
    "trade_count": "tno", "volume": "tvol", "value": "tval", "ind_buy_vol": "Buy_I_Volume", "inst_buy_vol": "Buy_N_Volume",
    "ind_sell_vol": "Sell_I_Volume", "inst_sell_vol": "Sell_N_Volume", "ind_buy_count": "Buy_CountI", "inst_buy_count": "Buy_CountN",
    "ind_sell_count": "Sell_CountI", "inst_sell_count": "Sell_CountN",
}
FEED_B = {
    "price_last": "close_price", "price_close": "final_price", "price_first": "first_price", "price_max": "highest_price",
    "price_min": "lowest_price", "price_yesterday": "yesterday_price", "trade_count": "trade_number", "volume": "trade_volume",
    "value": "trade_value", "ind_buy_vol": "real_buy_volume", "inst_buy_vol": "co_buy_volume", "ind_sell_vol": "real_sell_volume",
    "inst_sell_vol": "co_sell_volume", "ind_buy_count": "real_buy_count", "ind_sell_count": "real_sell_count",
    "inst_buy_count": "co_buy_count", "inst_sell_count": "co_sell_count",
}
# Level fields -> vendor A key prefix; "no limit" placeholder of both vendors.
BOOK_A = {"BidPrice": "pd", "BidVol": "qd", "BidCount": "zd", "AskPrice": "po", "AskVol": "qo", "AskCount": "zo"}
NO_LIMIT = 999_999_999


def _elements(payloads: DataFrame) -> DataFrame:
    """(payload, ...) -> one row per element of each JSON array: its position and value. The last of repeated keys counts."""
    prepare(payloads.sparkSession)
    others = [c for c in payloads.columns if c != "payload"]
    return payloads.select(*others, F.posexplode(elements(F.col("payload"))).alias("row", "element")).withColumn("row", F.col("row").cast("bigint"))


def payload_rows(payloads: DataFrame) -> DataFrame:
    """(payload, ...) -> one row per object: its position, raw tokens and the other columns.

    Values may be nested (their token is their JSON text). Payloads that are not JSON arrays and elements that are not objects yield
    no rows; see ``rejected``.
    """
    rows = _elements(payloads)
    return rows.withColumn("raw", tokens(F.col("element"))).drop("element").filter(F.col("raw").isNotNull())


def bad_payloads(payloads: DataFrame) -> DataFrame:
    prepare(payloads.sparkSession)
    return payloads.filter(elements(F.col("payload")).isNull())


def rejected(payloads: DataFrame) -> DataFrame:
    """What ``payload_rows`` leaves out, with the reason and the text: whole payloads (row NULL) and elements; a null element is nothing."""
    others = [c for c in payloads.columns if c != "payload"]
    whole = bad_payloads(payloads).select(*others, F.lit(None).cast("bigint").alias("row"), F.lit("payload is not a JSON array").alias("reason"), "payload")
    kind = F.schema_of_variant("element")
    parts = _elements(payloads).filter((kind != "VOID") & ~kind.startswith("OBJECT<"))
    return whole.unionByName(parts.select(*others, "row", F.lit("element is not a JSON object").alias("reason"), F.to_json("element").alias("payload")))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Saved payload files, one JSON array each: (path, ingest_time, payload)."""
    return spark.read.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_modification_time").alias("ingest_time"), F.col("value").alias("payload"))


def _valid(value: Column, is_price: bool, above: int) -> Column:
    return F.when(value > above if is_price else value >= 0, value)


def _limits(lo: Column, hi: Column) -> dict[str, Column]:
    usable = (lo > 1) & (hi >= lo) & (hi < NO_LIMIT)
    return {"price_limit_min": F.when(usable, lo), "price_limit_max": F.when(usable, hi)}


def _book_a() -> Column:
    """Five levels, all 30 values required."""
    book = F.transform(F.array(*[F.lit(str(i)) for i in range(1, 6)]), lambda i: F.struct(*[
        F.try_element_at("numbers", F.concat(F.lit(prefix), i)).alias(name) for name, prefix in BOOK_A.items()]))
    whole = F.filter(F.array(book), lambda levels: F.forall(levels, lambda x: F.concat(*[x[n].cast("string") for n in BOOK_A]).isNotNull()))
    return F.get(whole, F.lit(0))


def _parsed(rows: DataFrame, code: str, symbol: str) -> DataFrame:
    """Texts and integers of every key at once."""
    out = rows.withColumn("texts", F.transform_values("raw", lambda k, v: text(v)))
    out = out.withColumn("numbers", F.transform_values("texts", lambda k, v: num(v)))
    return out.withColumns({"ins_code": F.coalesce(F.col("texts")[code], F.lit("")), "symbol": F.coalesce(F.col("texts")[symbol], F.lit(""))})


def _canonical(rows: DataFrame, source: str, fields: dict[str, str], limits: dict[str, Column], book: Column | None) -> DataFrame:
    """Missing list and NULLs of the canonical row; both vendors send no snapshot time."""
    out = rows.withColumns(limits).withColumn("book", F.lit(None).cast("array<struct<BidPrice:bigint,BidVol:bigint,BidCount:bigint,AskPrice:bigint,"
                                                                       "AskVol:bigint,AskCount:bigint>>") if book is None else book)
    listed = [F.when(F.col(f).isNull(), F.lit(f)) for f in fields if f != "value"]
    late = F.when(F.col("value").isNull() & F.col("value_placeholder"), F.lit("value"))
    early = F.when(F.col("value").isNull() & ~F.col("value_placeholder"), F.lit("value"))
    position = list(fields).index("value")
    missing = [*listed[:position], early, *listed[position:], late, F.when(F.col("price_limit_min").isNull(), F.lit("price_limits")),
               F.when(F.col("book").isNull(), F.lit("book"))]
    return out.withColumn("missing", F.array_compact(F.array(*missing))).select(
        "row", "ins_code", "symbol", F.lit(source).alias("source"), F.col("ingest_time").alias("source_time"), "ingest_time",
        F.lit(True).alias("source_time_estimated"), *fields, *limits, "book", "missing")


def ingest_a(rows: DataFrame, source: str = "feed_a") -> DataFrame:
    """Feed A. Prices of 1 rial are placeholders, and void the traded value unless nothing traded."""
    out = _parsed(rows, "id", "l18").filter(F.col("ins_code").rlike("^[0-9]+$"))
    out = out.withColumns({f: _valid(F.col("numbers")[k], f.startswith("price_"), 1) for f, k in FEED_A.items()})
    void = F.col("price_last").isNull() & F.col("value").isNotNull() & (F.col("volume").isNull() | (F.col("volume") > 0))
    out = out.withColumn("value_placeholder", void).withColumn("value", F.when(~F.col("value_placeholder"), F.col("value")))
    return _canonical(out, source, FEED_A, _limits(F.col("numbers")["tmin"], F.col("numbers")["tmax"]), _book_a())


def ingest_b(rows: DataFrame, source: str = "feed_b") -> DataFrame:
    """Feed B. A price of 0 means no trade today; limits are decimal strings; the book is not mapped."""
    out = _parsed(rows, "instance_code", "name").filter(F.col("ins_code") != "")
    out = out.withColumns({f: _valid(F.col("numbers")[k], f.startswith("price_"), 0) for f, k in FEED_B.items()}).withColumn("value_placeholder", F.lit(False))
    low, high = (whole_decimal(F.col("texts")[k]) for k in ("daily_price_low", "daily_price_high"))
    return _canonical(out, source, FEED_B, _limits(low, high), None)


def union_payload_types(rows: DataFrame) -> DataFrame:
    """Union of several request types: the first row of an instrument wins, in (type_pos, row) order."""
    others = [c for c in rows.columns if c != "ins_code"]
    first = F.min_by(F.struct(*others), F.struct("type_pos", "row")).alias("f")
    return rows.groupBy("ins_code").agg(first).select("ins_code", "f.*")
