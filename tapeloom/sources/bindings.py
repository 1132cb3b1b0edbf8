"""Snapshot, vendor and daily-bar tables derived from the star-schema and event tables.

The event stream stands in for the exchange tape: every event is one poll of one instrument, and the
day-to-date totals are running sums of integers derived from it, with data defects at fixed positions.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.operators.calendar import DEFAULT_CALENDAR, Calendar, Rule
from tapeloom.operators.ordered import Prefix, running
from tapeloom.params import DEFAULT, Params
from tapeloom.runtime import prepare, stage

# The default hours plus one dated rule and one holiday inside the event range.
EVENT_CALENDAR = Calendar(
    rules=DEFAULT_CALENDAR.rules + (
        Rule("stock", date(2024, 1, 15), ("sat", "sun", "mon", "tue", "wed"), "08:40", "09:10", "13:00", True),),
    holidays=(date(2024, 1, 9),))
# Polls of one instrument are about half an hour apart in the event tables.
EVENT_PARAMS = dict(gap_after=45 * 60, warm_up=10, divergence_hot=2_000_000_000)


def event_params(**extra) -> Params:
    return Params(**{**EVENT_PARAMS, **extra})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def instrument_key() -> Column:
    return F.col("user_id") % 20


def ins_code(key: Column) -> Column:
    return F.concat(F.lit("I"), key.cast("string"))


def class_of_key(key: Column) -> Column:
    m = key % 7
    return (F.when(m.isin(0, 1), "stock").when(m == 2, "equity_etf").when(m == 3, "fixed_income")
            .when(m == 4, "gold").when(m == 5, "silver").otherwise("unknown"))


def _event_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
    ts = F.col("ts").cast("timestamp")
    day = F.to_date(ts)
    second = F.floor(F.unix_micros(ts) / 1_000_000) - F.unix_timestamp(day.cast("timestamp"))
    e = e.withColumns({"k": instrument_key(), "d": day, "s": second.cast("bigint")})
    offset = 17_700 + F.floor(F.col("s") * 2 / 5)
    dvol = (1 + F.col("event_id") % 40) * 10_000
    price = 10_000 + (F.col("event_id") * 37) % 400
    buyer = F.col("event_type").isin("click", "view", "purchase")
    seller = F.col("event_type").isin("click", "error")
    return e.select(
        F.col("event_id").alias("seq"), "k", "d", (F.unix_timestamp(F.col("d").cast("timestamp")) + offset).cast("bigint").alias("at"),
        price.alias("price_last"), dvol.alias("v"), (dvol * price).alias("val"),
        F.when(buyer, dvol).otherwise(F.lit(0)).alias("ib"), F.when(seller, dvol).otherwise(F.lit(0)).alias("is"),
        (F.col("event_id") % 3).alias("ibc"), (F.col("event_id") % 4).alias("isc"))


_SUMS = {"v": "volume", "val": "value", "ib": "ind_buy_vol", "is": "ind_sell_vol", "ibc": "ind_buy_count", "isc": "ind_sell_count"}


def snapshots(spark: SparkSession, sf_dir: str, p: Params = DEFAULT, staged: bool = True) -> DataFrame:
    """The canonical snapshot table (with class) of the event stream, one row per event."""
    rows = _event_rows(spark, sf_dir)
    keys = ["k", "d"]
    prefixes = [Prefix(name, F.col(src), "sum") for src, name in _SUMS.items()]
    prefixes += [Prefix("trade_count", F.lit(1).cast("bigint"), "sum"), Prefix("first_seq", F.col("seq"), "min")]
    totals = running(rows, keys, prefixes, p.chunk_rows)

    # Final totals of each instrument-day, handed to the first row of the instrument's next day with data.
    names = [*_SUMS.values(), "trade_count"]
    day_end = rows.groupBy(*keys).agg(F.min("seq").alias("seq"), *[F.sum(s).alias(n) for s, n in _SUMS.items()],
                                      F.count(F.lit(1)).alias("trade_count"))
    by_day = W.partitionBy("k").orderBy("d")
    before = day_end.select("k", "seq", *[F.lag(n).over(by_day).alias(f"y_{n}") for n in names])
    before = before.filter((F.col("k") % 3 == 0) & F.col("y_volume").isNotNull()).drop("k")
    out = totals.join(before, "seq", "left")

    first = F.col("seq") == F.col("first_seq")
    zeroed, repeat = first & (F.col("k") % 3 == 1), F.col("y_volume").isNotNull()
    cols = {n: F.when(zeroed, F.lit(0)).when(repeat, F.col(f"y_{n}")).otherwise(F.col(n)).cast("bigint") for n in names}
    out = out.withColumns(cols)
    seq, k = F.col("seq"), F.col("k")
    est = k == 17
    ingest = F.col("at") + F.when(seq % 97 == 0, F.lit(120)).otherwise(1 + seq % 7)
    source = (F.when(est, ingest).when(seq % 61 == 0, F.col("at") - 2400).when(seq % 499 == 0, F.col("at") + 8000)
              .otherwise(F.col("at")))
    has_limits = k != 11
    out = out.select(
        "seq", ins_code(k).alias("ins_code"), F.concat(F.lit("S"), k.cast("string")).alias("symbol"),
        F.when((k == 19) & (seq % 4 == 3), "rebase:feed").otherwise("feed").alias("source"),
        F.timestamp_seconds(source).alias("source_time"), F.timestamp_seconds(ingest).alias("ingest_time"),
        est.alias("source_time_estimated"), "price_last", F.lit(10_200).cast("bigint").alias("price_yesterday"),
        F.when(has_limits, F.lit(10_050)).cast("bigint").alias("price_limit_min"),
        F.when(has_limits, F.lit(10_350)).cast("bigint").alias("price_limit_max"),
        F.when(k != 14, F.col("trade_count")).alias("trade_count"),
        F.when(seq % 89 == 0, F.col("volume") - 500_000).otherwise(F.col("volume")).alias("volume"),
        F.when(seq % 131 != 0, F.col("value")).alias("value"), "ind_buy_vol", "ind_sell_vol",
        (F.col("volume") - F.col("ind_buy_vol") + F.when(seq % 101 == 0, F.lit(10)).otherwise(F.lit(0))).alias("inst_buy_vol"),
        (F.col("volume") - F.col("ind_sell_vol")).alias("inst_sell_vol"),
        F.when(seq % 53 != 0, F.col("ind_buy_count")).alias("ind_buy_count"), "ind_sell_count",
        class_of_key(k).alias("class"))
    listed = {"price_limits": F.col("price_limit_min"), "trade_count": F.col("trade_count"),
              "value": F.col("value"), "ind_buy_count": F.col("ind_buy_count")}
    out = out.withColumn("missing", F.array_compact(F.array(*[F.when(c.isNull(), F.lit(n)) for n, c in listed.items()])))
    return stage(out, "snapshots") if staged else out


# Instruments of the rehearsal and the days (number from 2024-01-01, modulo, remainders) on which each shows its case.
REHEARSAL = {"stands_still": (8, 3, (0, 1)), "untraded": (15, 4, (1,)), "no_price": (1, 5, (2,)), "no_limits": (14, 6, (3,)), "flat": (7, 2, (0,)),
             "before_open": (2, 5, (4,))}
DEFECTS = (53, 61, 89, 101, 131, 499)  # positions of the defects that ``snapshots`` puts into the tape


def rehearsal(snaps: DataFrame) -> DataFrame:
    """``snapshots`` with days on which every rule of the market state has something to do.

    One instrument repeats its totals over two days (awaits a reset), one does not trade, one has no price, one no limits, one closes
    where it closed the day before, one is shown before the open only. One is seen a day ahead now and then, so that what follows is of
    an earlier day and its totals lag. Gold and silver are without defects on even days, from an empty row before the open on.
    """
    def on(case: str) -> Column:
        key, modulo, rest = REHEARSAL[case]
        return (F.col("k") == key) & (F.col("n") % modulo).isin(*rest)

    day = F.to_date(F.from_utc_timestamp("source_time", "Asia/Tehran"))
    out = snaps.withColumns({"k": F.substring("ins_code", 2, 9).cast("int"), "day": day, "n": F.datediff(day, F.lit(date(2024, 1, 1)))})
    clean = F.col("class").isin("gold", "silver") & (F.col("n") % 2 == 0)
    broken = F.lit(False)
    for d in DEFECTS:
        broken = broken | (F.col("seq") % d == 0)
    out = out.filter(~(clean & broken)).withColumn("first", clean & (F.row_number().over(W.partitionBy("ins_code", "day").orderBy("seq")) == 1))
    start = F.unix_timestamp(F.to_utc_timestamp(F.col("day").cast("timestamp"), "Asia/Tehran"))
    early = F.timestamp_seconds(start + 30_000)
    compressed = F.timestamp_seconds(start + 3600 + F.floor((F.unix_timestamp("source_time") - start) / 10))
    ahead = (F.col("k") == 9) & (F.col("seq") % 53 == 5)
    still = {"volume": 5_000_000, "value": 50_000_000_000, "trade_count": 100, "ind_buy_vol": 3_000_000, "ind_sell_vol": 2_000_000, "inst_buy_vol": 2_000_000,
             "inst_sell_vol": 3_000_000, "ind_buy_count": 40, "ind_sell_count": 30}
    cols = {c: F.when(F.col("first") | on("untraded"), F.lit(0)).when(on("stands_still"), F.lit(v)).otherwise(F.col(c)).cast("bigint") for c, v in still.items()}
    cols["price_last"] = F.when(~on("no_price"), F.col("price_last"))
    cols["price_yesterday"] = F.when(on("flat"), F.col("price_last")).otherwise(F.col("price_yesterday"))
    cols |= {c: F.when(~on("no_limits"), F.col(c)) for c in ("price_limit_min", "price_limit_max")}
    cols["source_time"] = (F.when(F.col("first"), early).when(on("before_open"), compressed)
                           .when(ahead, F.col("source_time") + F.expr("INTERVAL 1 DAY")).otherwise(F.col("source_time")))
    cols["ingest_time"] = F.when(F.col("first"), F.timestamp_seconds(start + 30_001)).otherwise(F.col("ingest_time"))
    out = out.withColumns(cols)
    listed = {"price_last": "price_last", "price_limits": "price_limit_min", "trade_count": "trade_count", "value": "value", "ind_buy_count": "ind_buy_count"}
    missing = F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(n)) for n, c in listed.items()]))
    return out.withColumn("missing", missing).select(*snaps.columns)


def instruments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Instrument -> class map of the event stream (one row per instrument)."""
    keys = table(spark, sf_dir, "events").select(instrument_key().alias("k")).distinct()
    return keys.filter(F.col("k") % 7 != 6).select(ins_code(F.col("k")).alias("ins_code"), class_of_key(F.col("k")).alias("class"))


# --- vendor payloads from the part table -----------------------------------------------------------

_PREFIXES = ["IRO1", "IRO3", "IRO7", "IRR1", "IRB3", "IRTK", "IRE9", "IRT1", "IRXX"]
_FUNDS = ["صندوق سهام", "صندوق درآمد ثابت", "صندوق املاک", "صندوق آلفا-د"]
_COMMODITY = ["صندوق نقره", "صندوق زعفران", "صندوق طلا"]


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identity and totals each part shows as an instrument."""
    pk = F.col("pk")
    rows = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("pk"), "p_name", F.col("p_size").cast("bigint").alias("size"))
    rows = rows.withColumns({"price": F.col("size") * 1000 + pk % 97, "vol": pk % 13 * 1000,
                             "base": F.when(pk % 31 == 0, F.col("p_name")).otherwise(F.concat("p_name", pk.cast("string")))})
    board = F.when(pk % 37 == 0, "0002").otherwise("0001")
    name = (F.when(pk % 9 == 7, _pick(_FUNDS, pk % 4)).when(pk % 9 == 5, _pick(_COMMODITY, pk % 3))
            .otherwise(F.concat(F.lit("شرکت"), pk.cast("string"))))
    return rows.withColumns({
        "isin": F.concat(_pick(_PREFIXES, pk % 9), F.lpad((pk % 10000).cast("string"), 4, "0"), board),
        "sector": F.when(pk % 9 == 7, 68).when(pk % 9 == 4, 69).otherwise(pk % 60).cast("bigint"), "title": name,
        "ib": F.expr("vol div 5") * (pk % 5), "isell": F.expr("vol div 4") * (pk % 4), "value": F.col("vol") * F.col("price")})


def _str(c: Column) -> Column:
    return F.concat(F.lit('"'), c.cast("string"), F.lit('"'))


def _num(c: Column) -> Column:
    return c.cast("string")


def _payloads(rows: DataFrame, cells: dict[str, Column], per_payload: int = 100) -> DataFrame:
    """JSON arrays of at most ``per_payload`` objects: (payload_no, ingest_time, payload).

    Every third array ends with elements that are no objects; every fourth payload comes a second time as an error object.
    """
    body = F.concat_ws(",", *[F.concat(F.lit(f'"{k}":'), v) for k, v in cells.items()])
    objs = rows.select("pk", F.concat(F.lit("{"), body, F.lit("}")).alias("obj"), F.expr(f"pk div {per_payload}").alias("payload_no"))
    arrays = objs.groupBy("payload_no").agg(F.sort_array(F.collect_list(F.struct("pk", "obj"))).alias("o"))
    strays = F.when(F.col("payload_no") % 3 == 0, ',7,null,"x",[{"id":1,"l18":"in a list"}]').otherwise("")
    text = F.concat(F.lit("["), F.array_join(F.transform("o", lambda x: x["obj"]), ","), strays, F.lit("]"))
    at = F.timestamp_seconds(1_704_096_000 + F.col("payload_no")).alias("ingest_time")
    failed = arrays.filter(F.col("payload_no") % 4 == 0).select("payload_no", at, F.lit('{"successful":false,"rows":[{"id":1}]}').alias("payload"))
    return arrays.select("payload_no", at, text.alias("payload")).unionByName(failed)


def payloads_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    pk = F.col("pk")
    price, vol = F.col("price"), F.col("vol")
    time = F.concat(F.lpad((9 + pk % 4).cast("string"), 2, "0"), F.lit(":"), F.lpad((pk % 60).cast("string"), 2, "0"), F.lit(":00"))
    cells = {
        "id": _num(1_000_000 + pk - F.when(pk % 29 == 0, 1).otherwise(0)), "l18": _str(F.concat(F.lit("کی"), "base")), "l30": _str(F.col("title")),
        "isin": _str(F.col("isin")), "cs_id": _num(F.col("sector")),
        # every fifth object has its last price twice; the later one counts
        "pl": F.concat(F.when(pk % 5 == 0, '"12.5","pl":').otherwise(""), F.when(pk % 61 == 0, "1").otherwise(_num(price))), "pc": _num(price),
        "py": _num(price - 5), "tmin": F.when(pk % 45 == 0, "1").otherwise(_num(price - 100)),
        "tmax": F.when(pk % 47 == 0, "999999999").otherwise(_num(price + 100)), "tno": _num(pk % 50), "tvol": _num(vol), "tval": _num(F.col("value")),
        "Buy_I_Volume": _num(F.col("ib")), "Buy_N_Volume": _num(vol - F.col("ib") + F.when(pk % 27 == 0, 7).otherwise(0)),
        "Sell_I_Volume": _num(F.col("isell")), "Sell_N_Volume": F.when(pk % 33 == 0, "null").otherwise(_num(vol - F.col("isell"))),
        "time": _str(time), "base_volume": F.when(pk % 7 == 0, '{"v":[1,{"id":5}],"v":2,"t":"a}b,\\"{"}').otherwise(_num(pk % 7))}
    return _payloads(_parts(spark, sf_dir), cells)


def payloads_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    pk = F.col("pk")
    price, vol = F.col("price"), F.col("vol")
    arabic = F.translate(F.col("title"), "ی", "ي")
    title = F.when((pk % 9 == 7) & (pk % 10 == 3), F.lit("صندوق")).otherwise(arabic)
    volume = vol + F.when(pk % 59 == 0, 1000).otherwise(0)
    separated = F.when(volume == 0, "0").otherwise(F.concat((volume / 1000).cast("bigint").cast("string"), F.lit(",000")))
    date = F.concat(F.lit("1403/"), (1 + pk % 12).cast("string"), F.lit("/"), (1 + pk % 29).cast("string"))
    cells = {
        "instance_code": F.when(pk % 23 == 0, '""').otherwise(_str(1_000_000 + pk)), "name": _str(F.concat(F.lit("كي "), "base")),
        "full_name": _str(title), "namad_code": _str(F.col("isin")), "industry_code": _str(F.lpad(F.col("sector").cast("string"), 4, "0")),
        "close_price": _str(price + F.when(pk % 17 == 0, 1).otherwise(0)),
        "final_price": F.when(pk % 41 == 0, '"n/a"').otherwise(_str(F.concat(price.cast("string"), F.lit(".00")))),
        "yesterday_price": F.when(pk % 43 == 0, '"۱۲"').otherwise(_str(price - 5)),
        "daily_price_low": _str(F.concat((price - 100).cast("string"), F.lit(".00"))),
        "daily_price_high": _str(F.concat((price + 100).cast("string"), F.when(pk % 53 == 0, ".50").otherwise(".00"))),
        "trade_number": F.when(pk % 19 == 0, '""').otherwise(_str(pk % 50)), "trade_volume": _str(separated), "trade_value": _str(F.col("value")),
        "real_buy_volume": _str(F.col("ib")), "co_buy_volume": _str(vol - F.col("ib")), "real_sell_volume": _str(F.col("isell")),
        "co_sell_volume": _str(vol - F.col("isell")), "last_trade_date": _str(date),
        "last_trade_time": _str(F.concat((9 + pk % 4).cast("string"), F.lit(":05:00"))), "state": F.when(pk % 3 == 0, '"A"').otherwise("null")}
    return _payloads(_parts(spark, sf_dir).filter(pk % 11 != 0), cells)


# --- daily bars from the lineitem table ------------------------------------------------------------

# Few instruments and about two trades per bar: smaller cross sections, shorter windows, a wider setup.
BAR_PARAMS = dict(min_cross_section=5, ad_min_days=20, high_days=(20, 60), g1_ad_pct=20.0, g1_persistence=1, g1_atr_ratio=1.5, g1_vol_dryup=1.5,
                  g1_ret_pct=1000.0, g1_level_days=3, g1_rvol=0.5, max_stop_atr=50.0, min_events=5, m3_power=0.5, m3_sellers=1.0, m3_weak_days=1)


def bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of ten instruments; yesterday's price is halved or doubled on fixed days (adjustments)."""
    li = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("B"), (F.col("l_suppkey") % 10).cast("string")).alias("ins"), F.to_date(F.col("l_shipdate").cast("timestamp")).alias("day"),
        F.col("l_quantity").cast("bigint").alias("qty"), (2000 + F.round(F.col("l_extendedprice") / F.col("l_quantity")).cast("bigint") % 200).alias("price"),
        "l_orderkey", "l_linenumber", "l_returnflag", "l_linestatus")
    value = F.col("qty") * F.col("price")
    buys, sells = F.col("l_returnflag").isin("A", "N"), F.col("l_linestatus") == "O"
    at = F.struct("l_orderkey", "l_linenumber", "price")

    def total(cond: Column, what: Column) -> Column:
        return F.sum(F.when(cond, what).otherwise(F.lit(0)))

    daily = li.groupBy("ins", "day").agg(
        F.min(at)["price"].alias("pf"), F.max(at)["price"].alias("pl"), F.min("price").alias("pmin"), F.max("price").alias("pmax"),
        F.count(F.lit(1)).alias("tno"), F.sum("qty").alias("tvol"), F.sum(value).alias("tval"), total(buys, F.col("qty")).alias("buy_i_vol"),
        total(sells, F.col("qty")).alias("sell_i_vol"), total(buys, value).alias("buy_i_value"), total(sells, value).alias("sell_i_value"),
        F.count(F.when(buys, 1)).alias("buy_i_count"), F.count(F.when(sells, 1)).alias("sell_i_count"))
    daily = daily.withColumn("pc", F.expr("tval div tvol"))
    before = F.coalesce(F.lag("pc").over(W.partitionBy("ins").orderBy("day")), F.col("pc"))
    n = F.datediff("day", F.lit(date(1995, 1, 1)))
    return daily.withColumn("py", F.when(n % 1361 == 0, before * 2).when(n % 389 == 0, F.floor(before / 2)).otherwise(before).cast("bigint"))
