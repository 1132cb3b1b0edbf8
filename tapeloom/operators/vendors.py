"""Reconciliation of two vendor feeds.

A feed is a table (row, raw): the row's position in its payload and a map of raw JSON tokens. Rows are
matched by instrument code, then by folded symbol; values are compared field by field.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import tehran
from tapeloom.functions.text import fold_name, instrument_code, loose_integer, parse_int3, parse_text, text, value_format
from tapeloom.operators.classmap import instrument_group, smallest_per_group

# Compared fields as (group, name, key of feed A, key of feed B, compared as text).
IDENTITY, PRICE, RANGE, TOTAL, SIDES, BOOK, OTHER = "شناسه", "قیمت", "دامنه", "جمع روز", "حقیقی/حقوقی", "دفتر", "سایر"
FIELDS = [
    (IDENTITY, "symbol", "l18", "name", True),
    (IDENTITY, "isin", "isin", "namad_code", True),
    (IDENTITY, "sector_code", "cs_id", "industry_code", False),
    (PRICE, "price_last", "pl", "close_price", False),
    (PRICE, "price_close", "pc", "final_price", False),
    (PRICE, "price_first", "pf", "first_price", False),
    (PRICE, "price_yesterday", "py", "yesterday_price", False),
    (PRICE, "price_min", "pmin", "lowest_price", False),
    (PRICE, "price_max", "pmax", "highest_price", False),
    (RANGE, "price_limit_min", "tmin", "daily_price_low", False),
    (RANGE, "price_limit_max", "tmax", "daily_price_high", False),
    (TOTAL, "trade_count", "tno", "trade_number", False),
    (TOTAL, "volume", "tvol", "trade_volume", False),
    (TOTAL, "value", "tval", "trade_value", False),
    # The field names of the two vendors.
    (SIDES, "ind_buy_vol", "Buy_I_Volume", "real_buy_volume", False),
    (SIDES, "inst_buy_vol", "Buy_N_Volume", "co_buy_volume", False),
    (SIDES, "ind_sell_vol", "Sell_I_Volume", "real_sell_volume", False),
    (SIDES, "inst_sell_vol", "Sell_N_Volume", "co_sell_volume", False),
    (SIDES, "ind_buy_count", "Buy_CountI", "real_buy_count", False),
    (SIDES, "inst_buy_count", "Buy_CountN", "co_buy_count", False),
    (SIDES, "ind_sell_count", "Sell_CountI", "real_sell_count", False),
    (SIDES, "inst_sell_count", "Sell_CountN", "co_sell_count", False),
] + [
    (BOOK, f"{side}{i}_{what}", f"{key}{i}", f"{i}_{action}_{what_b}", False)
    for i in range(1, 6)
    for side, action, keys in (("bid", "buy", ("pd", "qd", "zd")), ("ask", "sell", ("po", "qo", "zo")))
    for what, what_b, key in zip(("price", "vol", "count"), ("price", "volume", "count"), keys)
] + [
    (OTHER, "market_value", "mv", "market_value", False),
    (OTHER, "eps", "eps", "eps", False),
]
STATIC_FIELDS = ["symbol", "isin", "sector_code", "price_yesterday", "price_limit_min", "price_limit_max"]
KEYS_A = {"code": "id", "symbol": "l18", "isin": "isin", "sector": "cs_id", "name": "l30"}
KEYS_B = {"code": "instance_code", "symbol": "name", "isin": "namad_code", "sector": "industry_code", "name": "full_name"}
SIDE_KEYS = {
    "a": ("tvol", "Buy_I_Volume", "Buy_N_Volume", "Sell_I_Volume", "Sell_N_Volume"),
    "b": ("trade_volume", "real_buy_volume", "co_buy_volume", "real_sell_volume", "co_sell_volume"),
}


def _token(key: str, raw: str = "raw") -> Column:
    return F.col(raw)[key]


def identities(feed: DataFrame, keys: dict[str, str]) -> DataFrame:
    """(row, code, symbol, folded, isin, sector, name) of a feed; code is NULL unless digits only."""
    rows = feed.select("row", *[text(_token(key)).alias(name) for name, key in keys.items()])
    return rows.withColumns({"code": instrument_code(F.col("code")), "folded": fold_name(F.col("symbol"))})


def _unique(ids: DataFrame, key: str) -> DataFrame:
    """(key, row, code) of keys found on exactly one row: counted before any join, so repeats cost nothing."""
    return ids.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("row"), F.min("symbol").alias("symbol"),
                                F.max("code").alias("_code")).withColumnRenamed("_code", "first_code")


def match_by_code(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of rows with the same code, each code on exactly one row of its feed. ``a`` and ``b`` are identities."""
    def once(ids: DataFrame, side: str) -> DataFrame:
        return _unique(ids.filter(F.col("code").isNotNull()), "code").filter("n = 1").select("code", F.col("row").alias(f"row_{side}"))

    return once(a, "a").join(once(b, "b"), "code")


def repeated_codes(ids: DataFrame) -> DataFrame:
    return ids.filter(F.col("code").isNotNull()).groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def symbol_outcomes(left_a: DataFrame, left_b: DataFrame) -> DataFrame:
    """Outcome of every folded symbol both feeds still have: pair, ambiguous or id_conflict."""
    def named(ids: DataFrame, side: str) -> DataFrame:
        return _unique(ids.filter(F.col("folded") != ""), "folded").select("folded", *[
            F.col(c).alias(f"{c}_{side}") for c in ("n", "row", "symbol", "first_code")])

    both = named(left_a, "a").join(named(left_b, "b"), "folded")
    outcome = (F.when((F.col("n_a") > 1) | (F.col("n_b") > 1), "ambiguous")
               .when(F.col("first_code_a").isNotNull() & F.col("first_code_b").isNotNull(), "id_conflict").otherwise("pair"))
    return both.withColumn("outcome", outcome)


def leftovers(ids: DataFrame, pairs: DataFrame, side: str) -> DataFrame:
    return ids.join(pairs.select(F.col(f"row_{side}").alias("row")), "row", "left_anti")


def match(a: DataFrame, b: DataFrame) -> DataFrame:
    """All pairs (row_a, row_b, by_name, key): by code first, then by symbol."""
    coded = match_by_code(a, b)
    named = symbol_outcomes(leftovers(a, coded, "a"), leftovers(b, coded, "b")).filter(F.col("outcome") == "pair")
    return coded.select("row_a", "row_b", F.lit(False).alias("by_name"), F.col("code").alias("key")).unionByName(
        named.select("row_a", "row_b", F.lit(True).alias("by_name"), F.col("folded").alias("key")))


def pair_rows(pairs: DataFrame, a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs with the raw values of both sides."""
    out = pairs.join(a.select(F.col("row").alias("row_a"), F.col("raw").alias("raw_a")), "row_a")
    return out.join(b.select(F.col("row").alias("row_b"), F.col("raw").alias("raw_b")), "row_b")


def field_values(joined: DataFrame, only: list[str] | None = None) -> DataFrame:
    """One row per pair and compared field (all, or those named), with the raw tokens and what they parse to."""
    fields = F.array(*[F.struct(F.lit(g).alias("group"), F.lit(n).alias("field"), F.lit(ka).alias("ka"), F.lit(kb).alias("kb"), F.lit(t).alias("is_text"))
                       for g, n, ka, kb, t in FIELDS if only is None or n in only])
    cells = F.transform(fields, lambda f: F.struct(
        f["group"].alias("group"), f["field"].alias("field"), f["is_text"].alias("is_text"),
        F.col("raw_a")[f["ka"]].alias("a"), F.col("raw_b")[f["kb"]].alias("b")))
    long = joined.select("row_a", "row_b", "by_name", "key", text(F.col("raw_a")["l18"]).alias("symbol"), F.inline(cells))

    long = long.withColumns({"text_a": text(F.col("a")), "text_b": text(F.col("b"))})

    def parsed(side: str) -> Column:
        s = F.col(f"text_{side}")
        return F.when(F.col("is_text"), parse_text(s)).otherwise(parse_int3(s))

    long = long.withColumns({"pa": parsed("a"), "pb": parsed("b")})
    ok_a, ok_b = F.col("pa.state") == "ok", F.col("pb.state") == "ok"
    bad_a, bad_b = F.col("pa.state") == "bad", F.col("pb.state") == "bad"
    kind = (F.when(ok_a & ok_b, F.when(F.col("pa.value") == F.col("pb.value"), "match").otherwise("mismatch"))
            .when((ok_a & bad_b) | (bad_a & ok_b), "mismatch").when(ok_a, "only_a").when(ok_b, "only_b")
            .when(~bad_a & ~bad_b, "neither").otherwise("both_bad"))
    return long.withColumn("kind", kind)


def field_stats(values: DataFrame) -> DataFrame:
    """Per field: every pair is a match, a mismatch, only on one side, on neither, or unparseable."""
    def n(cond: Column, name: str) -> Column:
        return F.count(F.when(cond, 1)).alias(name)

    kind = F.col("kind")
    return values.groupBy("group", "field").agg(
        n((F.col("pa.state") == "ok") & (F.col("pb.state") == "ok"), "both"), n(kind == "match", "match"),
        n((kind == "match") & (F.col("pa.value") != "0"), "nonzero_match"), n(kind == "mismatch", "mismatch"), n(kind == "only_a", "only_a"),
        n(kind == "only_b", "only_b"), n(kind == "neither", "neither"), n(kind == "both_bad", "both_bad"),
        n(F.col("pa.state") == "bad", "bad_a"), n(F.col("pb.state") == "bad", "bad_b"))


def field_formats(values: DataFrame) -> DataFrame:
    """How each vendor encodes each field."""
    sides = F.array(F.struct(F.lit("a").alias("vendor"), value_format(F.col("a"), F.col("text_a")).alias("format")),
                    F.struct(F.lit("b").alias("vendor"), value_format(F.col("b"), F.col("text_b")).alias("format")))
    return values.select("field", F.inline(sides)).groupBy("field", "vendor", "format").agg(F.count(F.lit(1)).alias("n"))


def mismatch_examples(values: DataFrame, n: int = 3) -> DataFrame:
    """The first mismatches of each field: pairs by code in code order, then pairs by symbol."""
    both_ok = (F.col("pa.state") == "ok") & (F.col("pb.state") == "ok")
    shown = F.concat(F.col("symbol"), F.lit(": "), F.when(both_ok, F.col("pa.value")).otherwise(F.col("text_a")), F.lit(" ≠ "),
                     F.when(both_ok, F.col("pb.value")).otherwise(F.col("text_b")))
    rows = values.filter(F.col("kind") == "mismatch").select("field", F.struct("by_name", "key", shown.alias("example")).alias("item"))
    picked = smallest_per_group(rows, ["field"], F.col("item"), n)
    return picked.select("field", "item.key", "item.example")


def extra_keys(a: DataFrame, b: DataFrame) -> DataFrame:
    """Keys of one feed that no compared field maps."""
    def unmapped(feed: DataFrame, vendor: str, position: int) -> DataFrame:
        mapped = [f[position] for f in FIELDS] + ["id", "instance_code"]
        return (feed.select(F.explode(F.map_keys("raw")).alias("key")).distinct().filter(~F.col("key").isin(mapped))
                .select(F.lit(vendor).alias("vendor"), "key"))

    return unmapped(a, "a", 2).unionByName(unmapped(b, "b", 3))


def groups(ids: DataFrame) -> DataFrame:
    return ids.withColumn("group", instrument_group(F.col("isin"), F.col("sector"), F.col("name"), F.col("symbol")))


def group_counts(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows per instrument group and feed, and pairs both feeds put in the group."""
    def per(rows: DataFrame, name: str) -> DataFrame:
        return rows.groupBy("group").agg(F.count(F.lit(1)).alias(name))

    same = paired_groups(a, b, pairs).filter(F.col("group_a") == F.col("group_b")).select(F.col("group_a").alias("group"))
    out = per(groups(a), "rows_a").join(per(groups(b), "rows_b"), "group", "full").join(per(same, "joined_same"), "group", "left")
    return out.fillna(0)


def paired_groups(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    ga = groups(a).select(F.col("row").alias("row_a"), F.col("group").alias("group_a"))
    gb = groups(b).select(F.col("row").alias("row_b"), F.col("group").alias("group_b"))
    return pairs.join(ga, "row_a").join(gb, "row_b")


def group_transitions(a: DataFrame, b: DataFrame, pairs: DataFrame) -> DataFrame:
    moved = paired_groups(a, b, pairs).filter(F.col("group_a") != F.col("group_b"))
    return moved.groupBy(F.concat_ws(" → ", "group_a", "group_b").alias("transition")).agg(F.count(F.lit(1)).alias("n"))


def duplicate_symbols(ids: DataFrame) -> DataFrame:
    return ids.groupBy("folded").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def latest_time(feed: DataFrame, date_key: str | None, time_key: str) -> DataFrame:
    """Latest time inside a payload; dates (Jalali, y/m/d) are compared number by number."""
    clock = text(_token(time_key))
    if date_key is None:
        return feed.select(F.max(clock).alias("latest"))
    date = text(_token(date_key))
    parts = F.split(date, "/")
    padded = F.when(F.size(parts) == 3, F.concat(F.lpad(F.get(parts, F.lit(0)), 4, " "), F.lpad(F.get(parts, F.lit(1)), 2, "0"),
                                                 F.lpad(F.get(parts, F.lit(2)), 2, "0"), F.lpad(clock, 8, " ")))
    return feed.select(F.max(F.when(padded.isNotNull(), F.struct(padded.alias("order"), F.concat_ws(" ", date, clock).alias("shown")))).alias("m")
                       ).select(F.col("m.shown").alias("latest"))


def static_window(at: Column) -> Column:
    """09:00 to 18:00 Tehran: both vendors are on the same trading day."""
    minute = F.hour(F.from_utc_timestamp(at, tehran.ZONE)) * 60 + F.minute(F.from_utc_timestamp(at, tehran.ZONE))
    return (minute >= 9 * 60) & (minute < 18 * 60)


def mismatch_by_group(stats: DataFrame) -> DataFrame:
    return stats.groupBy("group").agg(F.sum("mismatch").alias("n")).filter("n > 0")


def static_mismatch(stats: DataFrame, at: Column) -> DataFrame:
    """Mismatches of fields that do not change during the day; none outside the static window."""
    return stats.filter(static_window(at) & F.col("field").isin(STATIC_FIELDS) & (F.col("mismatch") > 0)).select("field", F.col("mismatch").alias("n"))


def volume_ahead(values: DataFrame) -> DataFrame:
    """Which vendor shows the larger day volume on a pair."""
    va, vb = F.col("pa.value").cast("bigint"), F.col("pb.value").cast("bigint")
    ok = (F.col("pa.state") == "ok") & (F.col("pb.state") == "ok")
    ahead = F.when(~ok, "missing").when((va == 0) & (vb == 0), "both_zero").when(va > vb, "a").when(vb > va, "b").otherwise("equal")
    return values.filter(F.col("field") == "volume").groupBy(ahead.alias("ahead")).agg(F.count(F.lit(1)).alias("n"))


def side_checks(feed: DataFrame, vendor: str) -> DataFrame:
    """Traded rows of a feed, and those whose sides are missing or do not add up to the volume."""
    names = ["v", "ib", "nb", "isell", "nsell"]
    rows = feed.select(*[text(_token(k)).alias(n) for n, k in zip(names, SIDE_KEYS[vendor])])
    rows = rows.select(*[loose_integer(F.col(n)).alias(n) for n in names])
    v, ib, nb, isell, nsell = (F.col(n) for n in names)
    parts = ib.isNull() | nb.isNull() | isell.isNull() | nsell.isNull()
    return rows.filter(v > 0).agg(
        F.lit(vendor).alias("vendor"), F.count(F.lit(1)).alias("traded"),
        F.count(F.when(~parts & ((ib + nb != v) | (isell + nsell != v)), 1)).alias("side_mismatch"), F.count(F.when(parts, 1)).alias("side_missing"))
