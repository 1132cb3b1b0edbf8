"""Row predicates and small derived values. A field listed in ``missing`` is NULL in the canonical table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tapeloom.params import DEFAULT, Params
from tapeloom.schemas import FLOW_FIELDS


def col_of(prefix: str, name: str) -> Column:
    return F.col(f"{prefix}{name}")


def all_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def flow_complete(prefix: str = "") -> Column:
    return all_of([col_of(prefix, f).isNotNull() for f in FLOW_FIELDS])


def missing_flow_fields(prefix: str = "") -> Column:
    return F.array_compact(F.array(*[F.when(col_of(prefix, f).isNull(), F.lit(f)) for f in FLOW_FIELDS]))


def has_price_limits(lo: Column, hi: Column) -> Column:
    return F.coalesce((lo > 0) & (hi >= lo), F.lit(False))


def totals_active(volume: Column, value: Column, trades: Column) -> Column:
    """Any day activity; a missing trade count cannot show any."""
    return (volume != 0) | (value != 0) | (F.coalesce(trades, F.lit(0)) != 0)


def totals_same(volume: Column, value: Column, trades: Column, volume2: Column, value2: Column, trades2: Column) -> Column:
    """Equal volume and value, and equal trade counts when both sides have one."""
    return (volume == volume2) & (value == value2) & F.coalesce(trades == trades2, F.lit(True))


def shows_trading(volume: Column, value: Column, trades: Column) -> Column:
    """Unknown volume counts as activity: its flow cannot be assumed zero."""
    return volume.isNull() | (volume > 0) | (F.coalesce(value, F.lit(0)) > 0) | (F.coalesce(trades, F.lit(0)) > 0)


def band(avg_ticket: Column, p: Params = DEFAULT) -> Column:
    return (F.when(avg_ticket >= p.hot_threshold, "hot")
            .when(avg_ticket >= p.plus_threshold, "hot_plus").otherwise("retail"))


def change_pct(last: Column, yesterday: Column) -> Column:
    return F.when((last > 0) & (yesterday > 0), (last - yesterday).cast("double") / yesterday * 100)


def window_change_pct(open_: Column, last: Column) -> Column:
    """Change over a window; 0 when undefined."""
    return F.when(open_ > 0, (last - open_).cast("double") / open_ * 100).otherwise(F.lit(0.0))


def map_bucket(chg: Column) -> Column:
    """Colour bucket 1 (>= +3 %) .. 5 (<= -3 %); NULL stays NULL."""
    return F.when(chg <= -3, 5).when(chg <= -1, 4).when(chg < 1, 3).when(chg < 3, 2).when(chg.isNotNull(), 1)


def is_synthetic(source: Column, ins_code: Column, symbol: Column) -> Column:
    return F.coalesce(
        (source == "synthetic") | source.startswith("rebase:") | ins_code.startswith("SYN")
        | F.coalesce(symbol, F.lit("")).startswith("SYN"), F.lit(False))


# Texts shown to users with a radar signal.
REASONS = {
    ("value_rate", True): "شدت معاملات به‌طور غیرعادی بالاتر از رفتار معمول همین نماد است",
    ("value_rate", False): "شدت معاملات به‌طور غیرعادی پایین‌تر از رفتار معمول همین نماد است",
    ("net_ind_rate", True): "ورود پول حقیقی به‌طور غیرعادی بالاتر از رفتار معمول همین نماد است",
    ("net_ind_rate", False): "خروج پول حقیقی به‌طور غیرعادی بالاتر از رفتار معمول همین نماد است",
}
DIVERGENCE_REASONS = {
    "absorption": "ورود پول درشت بدون رشد قیمت: احتمال عرضه پنهان",
    "support": "خروج پول درشت بدون افت قیمت: احتمال تقاضای پنهان",
}
PATTERN_TEXTS = {
    "hot_out_retail_in": "پول درشت خارج و پول خرد وارد شده است.",
    "hot_in_retail_out": "پول درشت وارد و پول خرد خارج شده است.",
    "both_in": "پول درشت و پول خرد هر دو وارد شده‌اند.",
    "both_out": "پول درشت و پول خرد هر دو خارج شده‌اند.",
    "none": "الگوی مشخصی دیده نمی‌شود.",
}


def lookup(key: Column, texts: dict[str, str]) -> Column:
    chain = None
    for k, v in texts.items():
        chain = F.when(key == k, v) if chain is None else chain.when(key == k, v)
    return chain


def anomaly_reason(feature: Column, z: Column) -> Column:
    chain = None
    for (feat, up), text in REASONS.items():
        cond = (feature == feat) & ((z > 0) if up else (z <= 0))
        if feat == "value_rate":
            cond = (feature == feat) & ((z >= 0) if up else (z < 0))
        chain = F.when(cond, text) if chain is None else chain.when(cond, text)
    return chain
