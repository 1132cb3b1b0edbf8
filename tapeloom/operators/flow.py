"""Money flow of accepted intervals: side flows, bands, day totals and session-aligned 10-minute windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions import rules, tehran
from tapeloom.operators.ordered import Prefix, running
from tapeloom.params import DEFAULT, Params

NETS = ["net_hot", "net_hot_plus", "net_retail", "net_unattributed"]
SIDES = {"buy": (1, "d_ind_buy_vol", "d_ind_buy_count"), "sell": (-1, "d_ind_sell_vol", "d_ind_sell_count")}


def is_interval() -> Column:
    return F.col("outcome") == "interval"


def traded() -> Column:
    """A usable interval in which volume grew."""
    return is_interval() & (F.col("d_volume") > 0)


def side_value(volume: Column) -> Column:
    """A side's share of the interval value, in double arithmetic, truncated."""
    share = F.col("d_value").cast("double") * volume.cast("double") / F.when(F.col("d_volume") > 0, F.col("d_volume")).cast("double")
    return share.cast("bigint")


def interval_vwap(accepted: DataFrame) -> DataFrame:
    return accepted.filter(traded()).select(
        "seq", "ins_code", "day", "d_value", "d_volume", F.expr("d_value div d_volume").alias("vwap"))


def side_flows(accepted: DataFrame) -> DataFrame:
    """One row per interval and side with positive real-person volume."""
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.lit(sign).alias("sign"), F.col(v).alias("volume"), F.col(n).alias("new_people"))
                      for s, (sign, v, n) in SIDES.items()])
    rows = accepted.filter(traded()).select(
        "seq", "ins_code", "symbol", "class", "day", "window_start", "price_last", "d_value", "d_volume",
        F.col("prev.source_time").alias("interval_from"), F.col("source_time").alias("interval_to"),
        F.expr("d_value div d_volume").alias("vwap"), F.inline(sides))
    return rows.filter(F.col("volume") > 0).withColumn("value", side_value(F.col("volume"))).drop("d_volume", "d_value")


def attribute(sides: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Average ticket and band where new people appeared; otherwise unattributed and never banded."""
    new = F.col("new_people") > 0
    avg = F.when(new, F.expr("value div new_people"))
    return sides.withColumns({
        "attribution": F.when(new, "attributed").otherwise("unattributed"),
        "participants": F.when(new, F.col("new_people")).otherwise(F.lit(0)),
        "avg_ticket": F.coalesce(avg, F.lit(0)).cast("bigint"),
        "band": F.when(new, rules.band(avg, p)),
    }).drop("new_people")


def flow_events(attributed: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Hot and hot_plus sides, and large unattributed ones (sized by the interval, not by a participant)."""
    large = F.when(F.col("attribution") == "unattributed", F.when(F.col("value") >= p.hot_threshold, "hot")).otherwise(F.col("band"))
    return attributed.withColumn("band", large).filter(F.col("band").isin("hot", "hot_plus")).select(
        "seq", "ins_code", "symbol", "class", "day", "side", "band", "attribution", "interval_from", "interval_to",
        "volume", "value", "participants", "avg_ticket", "vwap", "price_last")


def net_ind_value() -> Column:
    """Real-person net value of an interval; each side is truncated first."""
    return side_value(F.col("d_ind_buy_vol")) - side_value(F.col("d_ind_sell_vol"))


def intervals(accepted: DataFrame) -> DataFrame:
    """Value and real-person net value of every interval with trading; each side is truncated first."""
    return accepted.filter(traded()).select(
        "seq", "ins_code", "class", "day", "open", F.col("prev.source_time").alias("interval_from"),
        F.col("source_time").alias("interval_to"), F.col("d_value").alias("value"),
        net_ind_value().alias("net_ind_value"),
        F.col("prev.price_last").alias("price_from"), F.col("price_last").alias("price_to"))


def with_nets(accepted: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Signed value of each band per row (0 on rows without a usable interval), without unpivoting."""
    staged = {}
    for side, (_, vol, count) in SIDES.items():
        staged[f"_{side}"] = F.when(traded() & (F.col(vol) > 0), side_value(F.col(vol)))
        staged[f"_{side}_n"] = F.when(F.col(count) > 0, F.col(count))
    out = accepted.withColumns(staged)

    def kind(side: str) -> Column:
        return (F.when(F.col(f"_{side}_n").isNull(), "net_unattributed")
                .otherwise(F.concat(F.lit("net_"), rules.band(F.expr(f"_{side} div _{side}_n"), p))))

    out = out.withColumns({f"_{s}_kind": kind(s) for s in SIDES})

    def net(name: str) -> Column:
        return sum((sign * F.when(F.col(f"_{s}_kind") == name, F.coalesce(F.col(f"_{s}"), F.lit(0))).otherwise(F.lit(0))
                    for s, (sign, _, _) in SIDES.items()), F.lit(0)).cast("bigint")

    helpers = [f"_{s}{x}" for s in SIDES for x in ("", "_n", "_kind")]
    return out.withColumns({n: net(n) for n in NETS}).drop(*helpers)


def baselines_and_later(accepted: DataFrame) -> DataFrame:
    return accepted.filter(F.col("outcome").isin("day_baseline", "interval", "rebaseline"))


def day_totals(accepted: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Final totals of each instrument and day, as one combinable aggregation.

    The totals are published with every trade, and by a re-baseline if the day was not yet partial or the
    volume moved. Which publication came last follows from a few minima and maxima: the last trade, the
    first re-baseline, the first one with a volume, and the last one that moved the volume.
    """
    rows = with_nets(baselines_and_later(accepted), p)
    rebase = F.col("outcome") == "rebaseline"
    # Only numbers in the buffers, so that rows are hashed and combined as they come: each case keeps its seq, and time and volume there.
    cases = {"trade": (traded(), F.max, F.max_by), "rb": (rebase, F.min, F.min_by), "rb_volume": (rebase & (F.col("volume") != 0), F.min, F.min_by),
             "rb_moved": (rebase & (F.col("volume") != F.col("prev.volume")), F.max, F.max_by)}
    kept = [c for name, (cond, pick, pick_by) in cases.items() for at in [F.when(cond, F.col("seq"))]
            for c in (pick(at).alias(f"{name}_seq"), pick_by("source_time", at).alias(f"{name}_time"), pick_by("volume", at).alias(f"{name}_volume"))]
    # A new symbol of an instrument makes a second row here, of few, which the next step brings together.
    named = rows.groupBy("ins_code", "day", "class", "symbol").agg(
        *[F.sum(n).alias(n) for n in NETS], F.max("late").alias("late"), F.max("seq").alias("seq"), F.min(F.when(traded(), F.col("seq"))).alias("first_trade"), *kept)

    def again(name: str, pick, pick_by) -> list[Column]:
        at = F.col(f"{name}_seq")
        return [pick(at).alias(f"{name}_seq"), pick_by(f"{name}_time", at).alias(f"{name}_time"), pick_by(f"{name}_volume", at).alias(f"{name}_volume")]

    agg = named.groupBy("ins_code", "day").agg(
        F.max_by("class", "seq").alias("class"), F.max_by("symbol", "seq").alias("symbol"), *[F.sum(n).alias(n) for n in NETS], F.max("late").alias("late"),
        F.min("first_trade").alias("first_trade"), *[c for name, (_, pick, pick_by) in cases.items() for c in again(name, pick, pick_by)])

    def case(name: str) -> Column:
        return F.when(F.col(f"{name}_seq").isNotNull(), F.struct(
            F.col(f"{name}_seq").alias("seq"), F.col(f"{name}_time").alias("source_time"), F.col(f"{name}_volume").alias("volume")))

    late = F.col("late")
    first = F.least("first_trade", F.when(late, F.col("rb_volume_seq")).otherwise(F.col("rb_seq")))
    agg = agg.withColumn("first", first)
    last = F.greatest(
        case("trade"), F.when(F.col("rb_moved_seq") > F.col("first"), case("rb_moved")), F.when(~late, case("rb")),
        F.when(late & (F.col("rb_volume_seq") == F.col("first")), case("rb_volume")))
    return agg.withColumn("last", last).filter(F.col("last").isNotNull()).select(
        "ins_code", "symbol", "class", "day", F.col("last.seq").alias("seq"), F.col("last.source_time").alias("as_of"),
        F.col("last.volume").alias("volume"), *NETS, (late | F.col("rb_seq").isNotNull()).alias("partial"))


def day_progress(accepted: DataFrame, p: Params = DEFAULT, state: DataFrame | None = None) -> DataFrame:
    """Every baseline, interval and re-baseline with the day totals after it and whether they are published.

    ``state`` (see ``day_state``) continues the totals of an earlier run. Reads ``accepted`` twice.
    """
    rebase = F.col("outcome") == "rebaseline"

    def flag(cond: Column) -> Column:
        return F.when(cond, 1).otherwise(0)

    rows = with_nets(baselines_and_later(accepted), p).select(
        "seq", "ins_code", "symbol", "class", "day", "source_time", "volume", F.col("prev.volume").alias("prev_volume"), *NETS,
        flag(F.col("late")).alias("f_late"), flag(rebase).alias("f_rb"), flag(traded()).alias("f_trade"),
        flag(rebase & (F.col("volume") != 0)).alias("f_rb_volume"), F.lit(False).alias("kept"))
    if state is not None:
        rows = rows.unionByName(state.withColumn("kept", F.lit(True)))
    prefixes = [Prefix(f"t_{n}", F.col(n), "sum") for n in NETS] + [
        Prefix("late_so_far", F.col("f_late")), Prefix("rb_so_far", F.col("f_rb")), Prefix("rb_volume_so_far", F.col("f_rb_volume")),
        Prefix("trade_so_far", F.col("f_trade")), Prefix("rb_before", F.col("f_rb"), inclusive=False),
        Prefix("trade_before", F.col("f_trade"), inclusive=False), Prefix("rb_volume_before", F.col("f_rb_volume"), inclusive=False)]
    out = running(rows, ["ins_code", "day"], prefixes, p.chunk_rows)

    def on(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0)) == 1

    late, is_rb = on("late_so_far"), F.col("f_rb") == 1
    published_before = on("trade_before") | (late & on("rb_volume_before")) | (~late & on("rb_before"))
    moved = F.when(published_before, F.col("volume") != F.col("prev_volume")).otherwise(F.col("volume") != 0)
    emit = (F.col("f_trade") == 1) | (is_rb & (~(late | on("rb_before")) | moved))
    return out.filter(~F.col("kept")).withColumns({"published": emit, "partial": late | on("rb_so_far")})


def day_state(progress: DataFrame) -> DataFrame:
    """Last row of each instrument, in the form ``day_progress`` continues from."""
    cols = {"f_late": "late_so_far", "f_rb": "rb_so_far", "f_trade": "trade_so_far", "f_rb_volume": "rb_volume_so_far", **{n: f"t_{n}" for n in NETS}}
    keep = ["symbol", "class", "day", "source_time", "volume", "prev_volume"]
    last = F.max(F.struct("seq", *keep, *[F.col(src).alias(n) for n, src in cols.items()])).alias("l")
    return progress.groupBy("ins_code").agg(last).select("ins_code", "l.*")


def running_day_totals(accepted: DataFrame, p: Params = DEFAULT, state: DataFrame | None = None) -> DataFrame:
    """Every published state of the day totals."""
    return published_totals(day_progress(accepted, p, state))


def published_totals(progress: DataFrame) -> DataFrame:
    return progress.filter("published").select(
        "seq", "ins_code", "symbol", "class", "day", F.col("source_time").alias("as_of"), "volume", *[F.col(f"t_{n}").alias(n) for n in NETS], "partial")


def polling_gap(p: Params = DEFAULT) -> Column:
    """The interval reaches back before its window over a silence longer than ``gap_after``."""
    waited = tehran.trading_overlap(F.col("open"), F.col("close"), F.col("prev.ingest_time"), F.col("ingest_time"))
    return F.coalesce((F.col("prev.source_time") < F.col("window_start")) & (waited > p.gap_after), F.lit(False))


def _window_rows(accepted: DataFrame, p: Params) -> DataFrame:
    """Intervals, and the rows that make their window partial, with the polling-gap flag of each interval."""
    rows = accepted.filter(is_interval() | F.col("late") | (F.col("outcome") == "rebaseline"))
    gap = polling_gap(p)
    return with_nets(rows, p).select(
        "seq", "ins_code", "class", "day", "window_start", "price_last", "source_time", is_interval().alias("usable"), "net_hot",
        F.col("prev.price_last").alias("price_before"), gap.alias("gap"))


def ten_minutes(accepted: DataFrame, p: Params = DEFAULT) -> DataFrame:
    """Last state of every 10-minute window (one combinable aggregation). An instrument has one class."""
    usable = F.when(F.col("usable"), F.col("seq"))
    agg = _window_rows(accepted, p).groupBy("ins_code", "day", "class", "window_start").agg(
        F.sum(F.when(F.col("usable"), F.col("net_hot"))).alias("net_hot"), F.min(usable).alias("first"), F.min_by("price_before", usable).alias("price_open"),
        F.min_by("gap", usable).alias("gap"), F.max(usable).alias("last"), F.max_by("price_last", usable).alias("price_last"),
        F.max_by("source_time", usable).alias("updated_at"), F.min(F.when(~F.col("usable"), F.col("seq"))).alias("broken"))
    return agg.filter(F.col("first").isNotNull()).select(
        "ins_code", "class", "day", "window_start", "net_hot", "price_open", "price_last", "updated_at",
        (F.col("gap") | F.coalesce(F.col("broken") < F.col("last"), F.lit(False))).alias("partial"))


def window_progress(accepted: DataFrame, p: Params = DEFAULT, state: DataFrame | None = None) -> DataFrame:
    """Every row of a window with the window's state after it; ``state`` continues an earlier run."""
    usable = F.col("usable")
    rows = _window_rows(accepted, p).withColumn("kept", F.lit(False))
    if state is not None:
        rows = rows.unionByName(state.withColumn("kept", F.lit(True)))
    prefixes = [
        Prefix("net_so_far", F.when(usable, F.col("net_hot")), "sum"),
        Prefix("first", F.when(usable, F.struct("seq", "price_before", "gap")), "min"),
        Prefix("broken", F.when(usable, 0).otherwise(1), "max", inclusive=False),
        Prefix("broken_now", F.when(usable, 0).otherwise(1), "max")]
    out = running(rows, ["ins_code", "day", "window_start"], prefixes, p.chunk_rows)
    return out.filter(~F.col("kept"))


def window_state(progress: DataFrame) -> DataFrame:
    """What the latest window of each instrument hands on: its open state, and whether it is already partial."""
    broken = F.coalesce(F.col("broken_now"), F.lit(0)) == 1
    last = F.max(F.struct("seq", "class", "day", "window_start", "price_last", "source_time", "net_so_far", "first", broken.alias("broken"))).alias("l")
    rows = progress.groupBy("ins_code").agg(last).select("ins_code", "l.*")
    common = ["ins_code", "class", "day", "window_start", "price_last", "source_time"]
    open_state = rows.filter(F.col("first").isNotNull()).select(
        "seq", *common, F.lit(True).alias("usable"), F.col("net_so_far").alias("net_hot"), F.col("first.price_before").alias("price_before"),
        F.col("first.gap").alias("gap"))
    marks = rows.filter("broken").select(
        (F.col("seq") - 1).alias("seq"), *common, F.lit(False).alias("usable"), F.lit(0).cast("bigint").alias("net_hot"),
        F.lit(None).cast("bigint").alias("price_before"), F.lit(False).alias("gap"))
    return open_state.unionByName(marks)


def running_10m(accepted: DataFrame, p: Params = DEFAULT, state: DataFrame | None = None) -> DataFrame:
    """Every published state of every 10-minute window. Reads ``accepted`` twice."""
    return published_windows(window_progress(accepted, p, state))


def published_windows(progress: DataFrame) -> DataFrame:
    return progress.filter("usable").select(
        "seq", "ins_code", "class", "day", "window_start", F.col("net_so_far").alias("net_hot"),
        F.col("first.price_before").alias("price_open"), "price_last",
        (F.col("first.gap") | (F.coalesce(F.col("broken"), F.lit(0)) == 1)).alias("partial"))
