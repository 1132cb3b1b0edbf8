"""Market state of each trading day: latest rows, class flows, KPI values, breadth and the summary line.

A missing input gives NULL and is counted next to the value it is missing from; an aggregate never turns
it into a zero. Everything is computed for every trading day of the input at once.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions import rules, tehran
from tapeloom.operators.calendar import CLASSES, DEFAULT_CALENDAR, UNKNOWN, Calendar
from tapeloom.operators.ordered import Prefix, running
from tapeloom.params import DEFAULT, Params
from tapeloom.runtime import stage

STATE_COLUMNS = [
    "seq", "ins_code", "symbol", "class", "source", "source_time", "ingest_time", "source_time_estimated", "price_last", "price_yesterday",
    "price_limit_min", "price_limit_max", "trade_count", "volume", "value", "ind_buy_vol", "ind_sell_vol", "ind_buy_count", "ind_sell_count", "missing",
]
KEY = ["ins_code", "day"]
# KPI cards and the classes they add up.
KPI_CLASSES = {"value_stock": ["stock"], "value_fixed": ["fixed_income"], "value_metals": ["gold", "silver"]}
SECONDARY_CLASS = {"value_stock": "equity_etf"}


def _count(cond: Column) -> Column:
    return F.count(F.when(cond, 1))


def _trades() -> Column:
    return rules.shows_trading(F.col("volume"), F.col("value"), F.col("trade_count"))


def _complete() -> Column:
    return F.col("volume").isNotNull() & F.col("value").isNotNull()


def of_day(snaps: DataFrame, calendar: Calendar = DEFAULT_CALENDAR) -> DataFrame:
    """Snapshots with their day, session and ``carried``: a pre-open row already showing trading."""
    rows = snaps.select(*STATE_COLUMNS).withColumn("day", tehran.trading_day(F.col("source_time")))
    rows = calendar.with_session(rows, F.col("day"))
    return rows.withColumn("carried", F.coalesce(F.col("source_time") < F.col("open"), F.lit(False)) & _trades())


def latest_snapshots(rows: DataFrame) -> DataFrame:
    """Newest row per instrument and day by source time (the first arrival wins a tie)."""
    fields = [c for c in STATE_COLUMNS if c not in ("seq", "ins_code", "source_time")]
    newest = F.max(F.struct("source_time", (-F.col("seq")).alias("before"), *fields)).alias("s")
    return rows.filter(~F.col("carried")).groupBy(*KEY).agg(newest).select(
        *KEY, (-F.col("s.before")).alias("seq"), "s.source_time", *[f"s.{c}" for c in fields])


def carried_only(rows: DataFrame) -> DataFrame:
    """Instruments of a day whose only rows are pre-open ones showing the previous day's totals."""
    return rows.groupBy(*KEY).agg(F.min("carried").alias("only")).filter("only").select(*KEY)


def dashboard_reference(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """(ins_code, day) -> last totals of the previous day with data, taken from each day's latest row.

    Unlike the engine's reference, the day rolls with the clock and instruments are dropped against the
    day that ends.
    """
    last = stage(latest_snapshots(rows).filter(_complete()).select(*KEY, "volume", "value", "trade_count"), "last-totals")
    order = W.orderBy("day")
    data_days = last.select("day").distinct().withColumn("ended_before", F.lag("day").over(order))
    by_day = W.partitionBy("ins_code").orderBy("day")
    seen = last.join(data_days, "day").withColumns({"before": F.lag("day").over(by_day), "next_day": F.lead("day").over(by_day)})
    dropped = F.coalesce((F.col("before") != F.col("ended_before")) & (F.datediff("ended_before", "before") > p.keep_days), F.lit(False))
    seen = seen.withColumn("run", F.sum(dropped.cast("int")).over(by_day.rowsBetween(W.unboundedPreceding, 0)))
    totals = F.struct("volume", "value", "trade_count")
    active = rules.totals_active(F.col("volume"), F.col("value"), F.col("trade_count"))
    in_run = W.partitionBy("ins_code", "run").orderBy("day").rowsBetween(W.unboundedPreceding, 0)
    kept = seen.withColumn("kept", F.coalesce(F.last(F.when(active, totals), ignorenulls=True).over(in_run), totals))
    until = F.least(F.coalesce(F.date_sub("next_day", 1), F.date_add("day", p.keep_days)), F.date_add("day", p.keep_days))
    ended = kept.select("ins_code", "kept", F.explode(F.sequence("day", until)).alias("ref_day"))
    all_days = rows.select("day").distinct().join(last.select("day").distinct().withColumn("has", F.col("day")), "day", "left")
    all_days = all_days.withColumn("ref_day", F.last("has", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1)))
    days = all_days.filter(F.col("ref_day").isNotNull()).select("day", "ref_day")
    return ended.join(days, "ref_day").select(
        *KEY, "ref_day", F.col("kept.volume").alias("ref_volume"), F.col("kept.value").alias("ref_value"),
        F.col("kept.trade_count").alias("ref_trades"))


REFERENCE_STATE = "ins_code string, seen_day date, volume bigint, value bigint, trade_count bigint"


def carry_reference(state: DataFrame, rows: DataFrame, day: date, ended_before: date | None, p: Params = DEFAULT) -> DataFrame:
    """What instruments hand on after ``day``: the step of ``dashboard_reference`` from one day with data to the next.

    ``state`` (see ``REFERENCE_STATE``) is what they handed on before; ``rows`` are the snapshots of the day, ``ended_before`` the day with data before it.
    """
    last = latest_snapshots(rows).filter(_complete()).select("ins_code", "volume", "value", "trade_count")
    old = state.select("ins_code", F.struct("seen_day", "volume", "value", "trade_count").alias("old"))
    both = last.withColumn("new", F.struct("volume", "value", "trade_count")).select("ins_code", "new").join(old, "ins_code", "full")
    ended = F.lit(ended_before).cast("date")
    dropped = F.coalesce((F.col("old.seen_day") != ended) & (F.datediff(ended, F.col("old.seen_day")) > p.keep_days), F.lit(False))

    def active(side: str) -> Column:
        return F.coalesce(rules.totals_active(F.col(f"{side}.volume"), F.col(f"{side}.value"), F.col(f"{side}.trade_count")), F.lit(False))

    held = F.struct("old.volume", "old.value", "old.trade_count")
    kept = F.when(F.col("new").isNull() | (~active("new") & ~dropped & active("old")), held).otherwise(F.col("new"))
    seen = F.when(F.col("new").isNull(), F.col("old.seen_day")).otherwise(F.lit(day))
    return both.select("ins_code", seen.alias("seen_day"), kept.alias("k")).select("ins_code", "seen_day", "k.*")


def reference_after(state: DataFrame, day: date, ref_day: date | None, p: Params = DEFAULT) -> DataFrame:
    """The reference of ``day``, given what was handed on by the last day with data, ``ref_day``."""
    fresh = F.datediff(F.lit(ref_day).cast("date"), F.col("seen_day")) <= p.keep_days
    return state.filter(fresh).select("ins_code", F.lit(day).alias("day"), F.lit(ref_day).cast("date").alias("ref_day"), F.col("volume").alias("ref_volume"),
                                      F.col("value").alias("ref_value"), F.col("trade_count").alias("ref_trades"))


def accepted_rows(rows: DataFrame, reference: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Rows that became the instrument's latest one when they arrived, with the state they were judged in.

    ``repeats``: the row shows exactly the reference totals at or after the open. ``counted``: it belongs
    to today; rows repeating the previous day, and incomplete ones while waiting for a reset, do not.
    """
    ref = stage(reference, "market-reference")
    judged = rows.filter(~F.col("carried")).join(ref, KEY, "left")
    totals = [F.col(c) for c in ("volume", "value", "trade_count", "ref_volume", "ref_value", "ref_trades")]
    repeats = (~F.coalesce(F.col("source_time") < F.col("open"), F.lit(False)) & rules.totals_active(*totals[3:]) & rules.totals_same(*totals))
    judged = judged.withColumn("repeats", F.coalesce(repeats, F.lit(False))).drop("ref_volume", "ref_value", "ref_trades", "ref_day")
    before = Prefix("before", F.struct("source_time", (-F.col("seq")).alias("earlier"), "volume"), inclusive=False)
    newest = running(judged, KEY, [before], p.chunk_rows)
    newest = newest.filter(F.col("before").isNull() | (F.col("source_time") > F.col("before.source_time")))
    newest = stage(newest.withColumn("volume_before", F.col("before.volume")).drop("before"), "market-accepted")
    waiting = Prefix("waiting", F.when(_complete(), F.struct("seq", "repeats")), inclusive=False)
    out = running(newest, KEY, [waiting], p.chunk_rows)
    held = ~_complete() & F.coalesce(F.col("waiting.repeats"), F.lit(False))
    return out.withColumn("counted", ~F.col("repeats") & ~held).drop("waiting")


def day_states(accepted: DataFrame) -> DataFrame:
    """Per instrument and day: the latest row, whether it ever traded, and whether it awaits a reset."""
    fields = [c for c in STATE_COLUMNS if c not in ("seq", "ins_code", "source_time")]
    agg = accepted.groupBy(*KEY).agg(
        F.max(F.struct("source_time", "seq", *fields)).alias("s"), F.max(F.col("counted") & _trades()).alias("ever_traded"),
        F.max(F.when(_complete(), F.struct("seq", "repeats"))).alias("w"))
    return agg.select(*KEY, "s.seq", "s.source_time", *[f"s.{c}" for c in fields], "ever_traded",
                      F.coalesce("w.repeats", F.lit(False)).alias("awaiting"))


def market_table(states: DataFrame, games: DataFrame, issue_counts: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """States beside the engine's day totals and the issue counts; totals and issues show only with a snapshot."""
    g = games.select(*KEY, F.struct("as_of", "volume", "net_hot", "net_hot_plus", "net_retail", "net_unattributed", "partial").alias("game"))
    out = states.join(g, KEY, "left").join(issue_counts, KEY, "left").withColumn("issues", F.coalesce("issues", F.lit(0).cast("bigint")))
    behind = (rules.flow_complete() & (F.col("volume") > F.col("game.volume"))
              & (tehran.seconds_between(F.col("game.as_of"), F.col("source_time")) > p.lag_after))
    return out.withColumn("lagging", F.coalesce(behind, F.lit(False)))


def market_rows(table: DataFrame) -> DataFrame:
    """One row of the symbols table per instrument and day."""
    shown = ~F.col("awaiting")
    game = F.col("game").isNotNull()
    return table.select(
        F.col("ins_code").alias("ins"), F.col("symbol").alias("sym"), "class", "day",
        F.when(shown & (F.col("price_last") > 0), F.col("price_last")).alias("last"),
        F.when(shown & F.col("ever_traded"), rules.change_pct(F.col("price_last"), F.col("price_yesterday"))).alias("chg"),
        F.when(shown, F.col("value")).alias("value"),
        F.when(shown & game, F.col("game.net_hot")).when(shown & ~F.col("ever_traded"), F.lit(0).cast("bigint")).alias("net_hot"),
        F.when(shown, F.col("game.as_of")).alias("hot_as_of"), (shown & F.col("lagging")).alias("lagging"),
        F.col("ever_traded").alias("traded"), F.col("awaiting").alias("awaiting_reset"),
        F.coalesce(shown & F.col("game.partial"), F.lit(False)).alias("partial"), "missing",
        F.col("source_time").alias("src"), F.col("ingest_time").alias("ing"), F.col("source_time_estimated").alias("est"),
        rules.is_synthetic(F.col("source"), F.col("ins_code"), F.col("symbol")).alias("syn"), "issues")


def class_flow(table: DataFrame) -> DataFrame:
    """Real-person flow per day and class, with the counts that say how complete it is."""
    aw, game, traded = F.col("awaiting"), F.col("game").isNotNull(), F.col("ever_traded")
    gives = ~aw & (game | ~traded)

    def total(name: str) -> Column:
        return F.sum(F.when(gives, F.coalesce(F.col(f"game.{name}"), F.lit(0)))).alias(name)

    agg = table.filter(F.col("class").isin(CLASSES)).groupBy("day", "class").agg(
        F.count(F.lit(1)).alias("instruments"), _count(~aw & ~game & traded).alias("missing"),
        _count(gives & F.col("lagging")).alias("lagging"), _count(gives & F.col("value").isNull()).alias("value_missing"), _count(aw).alias("awaiting"),
        *[total(n) for n in ("net_hot", "net_hot_plus", "net_retail", "net_unattributed")],
        F.sum(F.when(gives, F.col("value"))).alias("value"), F.coalesce(F.max(gives & F.col("game.partial")), F.lit(False)).alias("partial"),
        F.max(F.when(gives, F.coalesce("game.as_of", "source_time"))).alias("as_of"), F.max(gives & F.col("source_time_estimated")).alias("est"))
    every = table.select("day").distinct().withColumn("class", F.explode(F.array(*[F.lit(c) for c in CLASSES])))
    out = every.join(agg, ["day", "class"], "left")
    counts = ["instruments", "missing", "lagging", "value_missing", "awaiting"]
    return out.fillna(0, counts).fillna(False, ["partial", "est"])


def flow_pattern(flows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Signs of the large and the retail flow; NULL unless every input is complete and current."""
    material = F.lit(p.materiality) * F.col("value").cast("double")

    def sign(name: str) -> Column:
        x = F.col(name).cast("double")
        return F.when(x >= material, 1).when(-x >= material, -1).otherwise(0)

    full = (~F.col("partial") & (F.col("missing") == 0) & (F.col("lagging") == 0) & (F.col("value_missing") == 0)
            & (F.col("awaiting") == 0) & F.col("net_hot").isNotNull())
    hot, retail = sign("net_hot"), sign("net_retail")
    rule = (F.when(F.coalesce(F.col("value"), F.lit(0)) <= 0, "none")
            .when((hot < 0) & (retail > 0), "hot_out_retail_in").when((hot > 0) & (retail < 0), "hot_in_retail_out")
            .when((hot > 0) & (retail > 0), "both_in").when((hot < 0) & (retail < 0), "both_out").otherwise("none"))
    return flows.withColumn("pattern", F.when(full, rule)).withColumn("pattern_text", rules.lookup(F.col("pattern"), rules.PATTERN_TEXTS))


def kpi_values(table: DataFrame) -> DataFrame:
    """Traded value per day and KPI card, with the secondary class shown on it."""
    aw, value = F.col("awaiting"), F.col("value")
    per_class = table.filter(F.col("class").isin(CLASSES)).groupBy("day", "class").agg(
        F.sum(F.when(~aw, value)).alias("value"), F.count(F.lit(1)).alias("instruments"), _count(~aw & value.isNull()).alias("missing"),
        _count(aw).alias("awaiting"), F.max(F.when(~aw & value.isNotNull(), F.col("source_time"))).alias("as_of"),
        F.max(~aw & value.isNotNull() & F.col("source_time_estimated")).alias("est"))
    cards = F.array(*[F.struct(F.lit(k).alias("kpi"), F.lit(c).alias("class"), F.lit(first).alias("main"))
                      for k, classes in KPI_CLASSES.items()
                      for c, first in [(c, True) for c in classes] + [(s, False) for s in [SECONDARY_CLASS.get(k)] if s]])
    every = table.select("day").distinct().select("day", F.inline(cards))
    joined = every.join(per_class, ["day", "class"], "left")
    main, other = F.col("main"), ~F.col("main")

    def total(name: str, cond: Column) -> Column:
        return F.sum(F.when(cond, F.coalesce(F.col(name), F.lit(0))))

    return joined.groupBy("day", "kpi").agg(
        F.sum(F.when(main, F.col("value"))).alias("value"), *[total(n, main).alias(n) for n in ("instruments", "missing", "awaiting")],
        F.max(F.when(main, F.col("as_of"))).alias("as_of"), F.coalesce(F.max(F.when(main, F.col("est"))), F.lit(False)).alias("est"),
        F.max(F.when(other, F.col("class"))).alias("secondary_class"), F.sum(F.when(other, F.col("value"))).alias("secondary_value"),
        *[total(n, other).alias(f"secondary_{n}") for n in ("instruments", "missing", "awaiting")])


def breadth(table: DataFrame) -> DataFrame:
    """Stocks that traded, by price change within their own permitted range."""
    last, y, lo, hi = (F.col(c) for c in ("price_last", "price_yesterday", "price_limit_min", "price_limit_max"))
    bucket = (F.when(F.col("awaiting"), "awaiting").when(~F.coalesce((last > 0) & (y > 0), F.lit(False)), "missing")
              .when(~F.col("ever_traded"), "untraded").when(~(rules.has_price_limits(lo, hi) & (hi > lo)), "no_limits")
              .when(last == y, "flat").when((last > y) & (last >= hi), "ceil").when(last > y, "up").when(last <= lo, "floor").otherwise("down"))
    names = ["missing", "untraded", "awaiting", "no_limits", "floor", "down", "flat", "up", "ceil"]
    placed = F.col("bucket").isin("flat", "ceil", "up", "floor", "down")
    agg = table.filter(F.col("class") == "stock").withColumn("bucket", bucket).groupBy("day").agg(
        F.count(F.lit(1)).alias("instruments"), *[_count(F.col("bucket") == n).alias(n) for n in names],
        F.max(F.when(placed, F.col("source_time"))).alias("as_of"), F.max(placed & F.col("source_time_estimated")).alias("est"))
    out = table.select("day").distinct().join(agg, "day", "left")
    return out.fillna(0, ["instruments", *names]).fillna(False, ["est"])


def market_summary(table: DataFrame, rows: DataFrame, reference: DataFrame, issue_counts: DataFrame,
                   calendar: Calendar = DEFAULT_CALENDAR) -> DataFrame:
    """One line per day: coverage, unknown share, carryover and reset counts, issues and the reference check."""
    unknown = F.col("class") == UNKNOWN
    base = table.groupBy("day").agg(
        F.max("source_time").alias("as_of"), F.max(rules.is_synthetic(F.col("source"), F.col("ins_code"), F.col("symbol"))).alias("syn"),
        F.max("source_time_estimated").alias("est"), F.count(F.lit(1)).alias("instruments"), _count(unknown).alias("unknown"),
        _count(F.col("awaiting")).alias("awaiting_reset"))
    carried = carried_only(rows).groupBy("day").agg(F.count(F.lit(1)).alias("carryover"))
    issues = issue_counts.groupBy("day").agg(F.sum("issues").alias("issues"))
    refs = reference.groupBy("day").agg(F.max("ref_day").alias("ref_day"))
    out = base.join(carried, "day", "left").join(issues, "day", "left").join(refs, "day", "left").fillna(0, ["carryover", "issues"])
    out = calendar.previous_trading_day(out)
    return out.withColumns({
        "unknown_share": F.col("unknown") / F.col("instruments"), "unknown_notice": 2 * F.col("unknown") > F.col("instruments"),
        "carryover_ok": F.coalesce(F.col("ref_day") == F.col("expected"), F.lit(False))})


# --- synthetic instruments -------------------------------------------------------------------------

def drop_synthetic(snaps: DataFrame) -> DataFrame:
    """Rows of real market data only."""
    return snaps.filter(~rules.is_synthetic(F.col("source"), F.col("ins_code"), F.col("symbol")))


def synthetic_instruments(snaps: DataFrame) -> DataFrame:
    return snaps.filter(rules.is_synthetic(F.col("source"), F.col("ins_code"), F.col("symbol"))).select("ins_code").distinct()


def hide_late_synthetic(events: DataFrame, snaps: DataFrame) -> DataFrame:
    """An instrument found to be synthetic at any time also hides what was derived from it before."""
    return events.join(synthetic_instruments(snaps), "ins_code", "left_anti")


# --- lists -----------------------------------------------------------------------------------------

def top_by(rows: DataFrame, column: str, n: int) -> DataFrame:
    """Largest first, missing values last, ties by code."""
    return rows.orderBy(F.desc_nulls_last(column), F.asc("ins")).limit(n)


def market_map(rows: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Largest traded values of each day with colour bucket and share of the drawn area."""
    return _map(rows.filter(F.col("value") > 0), p)


def _map(rows: DataFrame, p: Params) -> DataFrame:
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy("day").orderBy(F.desc("value"), F.asc("ins"))))
    drawn = ranked.filter(F.col("rank") <= p.map_tiles)
    share = F.col("value") / F.sum("value").over(W.partitionBy("day"))
    return drawn.select("day", "ins", "value", "rank", rules.map_bucket(F.col("chg")).alias("bucket"), share.alias("share"))


def without_value(rows: DataFrame) -> DataFrame:
    return rows.groupBy("day").agg(_count(F.col("value").isNull()).alias("no_value"))


def recent_signals(signals: DataFrame, snaps: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """The newest signals of the last day, with the instrument's symbol; synthetic instruments are hidden."""
    shown = hide_late_synthetic(signals, snaps).withColumn("on", tehran.trading_day(F.col("at")))
    today = signals.agg(F.max(tehran.trading_day(F.col("at"))).alias("on"))
    newest = shown.join(F.broadcast(today), "on").orderBy(F.desc("seq"), F.asc("kind"), F.asc("feature")).limit(p.radar_keep)
    symbols = snaps.groupBy("ins_code").agg(F.max_by("symbol", "source_time").alias("sym"))
    return newest.join(symbols, "ins_code", "left").select(F.col("ins_code").alias("ins"), "sym", "class", "kind", "feature", "z", "at", "reason")


def search_symbols(rows: DataFrame, query: str) -> DataFrame:
    text = query.strip()
    return rows.filter(F.col("sym").contains(text) | F.col("ins").contains(text))


def row_status(rows: DataFrame, calendar: Calendar = DEFAULT_CALENDAR, p: Params = DEFAULT) -> DataFrame:
    """Most severe status of each row at its ``now`` instant."""
    at = calendar.trading_at(rows, "now")
    age = tehran.seconds_between(F.when(F.col("est"), F.col("ing")).otherwise(F.col("src")), F.col("now"))
    status = (F.when(F.col("awaiting_reset"), "awaiting")
              .when(F.col("lagging") | (F.col("trading") & (age > p.stale_after)), "stale").when(F.col("partial"), "partial")
              .when((F.size("missing") > 0) | F.col("last").isNull() | F.col("value").isNull(), "incomplete")
              .when(F.col("class") == UNKNOWN, "unknown").otherwise("live"))
    return at.withColumn("status", status).drop("trading")


def changed_rows(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that are new or differ from the last publication."""
    old = before.select(*keys, F.struct(*[c for c in after.columns if c not in keys]).alias("_old"))
    now = F.struct(*[c for c in after.columns if c not in keys])
    return after.join(old, keys, "left").filter(~F.col("_old").eqNullSafe(now)).drop("_old")


def latency_p95(samples: DataFrame) -> DataFrame:
    """Nearest-rank 95th percentile of the latency per 5-minute window of receive time.

    Equal latencies are counted before they are ranked, so a busy window is no larger than its distinct values.
    """
    from_ = F.when(F.col("source_time_estimated"), F.col("ingest_time")).otherwise(F.col("source_time"))
    ms = ((F.unix_micros("received") - F.unix_micros(from_)) / 1000).cast("bigint")
    counted = samples.select(F.window("received", "5 minutes")["start"].alias("window_start"), ms.alias("ms"),
                             "source_time_estimated").groupBy("window_start", "ms").agg(
        F.count(F.lit(1)).alias("n"), F.max("source_time_estimated").alias("est"))
    w = W.partitionBy("window_start")
    ranked = counted.withColumns({"total": F.sum("n").over(w), "upto": F.sum("n").over(w.orderBy("ms")), "any": F.max("est").over(w)})
    return ranked.filter(F.col("upto") * 100 >= F.col("total") * 95).groupBy("window_start").agg(
        F.min("ms").alias("p95_ms"), F.max("total").alias("n"), F.when(F.max("any"), "ingest").otherwise("source").alias("basis"))
