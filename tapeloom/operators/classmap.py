"""Proposed instrument group and session class from vendor identity fields (a heuristic, unverified)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.text import ZWNJ, fold_letters

# Group labels.
ABNORMAL = "تابلو غیرعادی (…"
ENERGY = "انرژی (IRE9)"
RIGHTS = "حق تقدم"
BOND = "اوراق"
SILVER_FUND = "صندوق نقره"
GOLD_FUND = "صندوق طلا/کالا"
OTHER_COMMODITY = "صندوق کالایی دیگر (پلاتین، زعفران)"
FIXED_FUND = "صندوق درآمد ثابت"
EQUITY_FUND = "صندوق سهامی"
OTHER_FUND = "سایر صندوق‌ها"
MAIN_MARKET = "سهام بورس"
SECOND_MARKET = "سهام فرابورس"
BASE_MARKET = "بازار پایه/دیگر"
NO_GROUP = "نامشخص"
NO_CODE = "بدون کد"
DUPLICATE_CODE = "کد تکراری"
# Session class of each group; other groups stay unmapped.
CLASS_OF_GROUP = {
    MAIN_MARKET: "stock", SECOND_MARKET: "stock", BASE_MARKET: "stock", RIGHTS: "stock",
    EQUITY_FUND: "equity_etf", FIXED_FUND: "fixed_income", BOND: "fixed_income",
    GOLD_FUND: "gold", SILVER_FUND: "silver", OTHER_FUND: "other_fund",
}
# Words and tickers that tell funds apart.
ABNORMAL_BOARDS = ["0002", "0003", "0004"]
NON_GOLD_TICKERS = ["پلاتا", "سافرون"]
SAFFRON, SILVER_WORD = "زعفران", "نقره"
SILVER_TICKERS = ["نقر", "سیلو"]
FIXED_NAME = r"(-د|ثابت)$|درآمد ثابت|درآمدثابت"
EQUITY_NAME = r"(-س|-ب)$|سهام|شاخصی|بخشی|اهرم"


def instrument_group(isin: Column, sector: Column, name: Column, symbol: Column) -> Column:
    """First matching rule: board suffix, energy, rights, bonds, commodity funds, funds by name, market prefix."""
    sector = F.regexp_replace(F.trim(sector), "^0+", "")
    name = fold_letters(name)
    ticker = F.translate(fold_letters(F.trim(symbol)), " " + ZWNJ, "")
    board = F.substring(isin, 9, 4)
    commodity = isin.startswith("IRTK")
    silver = name.contains(SILVER_WORD) | ticker.startswith(SILVER_TICKERS[0]) | ticker.startswith(SILVER_TICKERS[1])
    fund = F.trim(name)
    return (
        F.when((F.length(isin) == 12) & board.isin(ABNORMAL_BOARDS), F.concat(F.lit(ABNORMAL), board, F.lit(")")))
        .when(isin.startswith("IRE9"), ENERGY)
        .when(isin.startswith("IRR"), RIGHTS)
        .when((sector == "69") | isin.rlike("^IRB[0-9]"), BOND)
        .when(commodity & (ticker.isin(NON_GOLD_TICKERS) | name.contains(SAFFRON)), OTHER_COMMODITY)
        .when(commodity & silver, SILVER_FUND)
        .when(commodity, GOLD_FUND)
        .when(sector == "68", F.when(fund.rlike(FIXED_NAME), FIXED_FUND).when(fund.rlike(EQUITY_NAME), EQUITY_FUND).otherwise(OTHER_FUND))
        .when(isin.startswith("IRO1"), MAIN_MARKET)
        .when(isin.startswith("IRO3"), SECOND_MARKET)
        .when(isin.startswith("IRO7") | isin.startswith("IRO5"), BASE_MARKET)
        .otherwise(NO_GROUP))


def group_class(group: Column) -> Column:
    """Session class of a group; NULL leaves the instrument unmapped."""
    chain = None
    for g, c in CLASS_OF_GROUP.items():
        chain = F.when(group == g, c) if chain is None else chain.when(group == g, c)
    return chain


def exclude_duplicate_codes(rows: DataFrame) -> DataFrame:
    """Mark rows whose code is on several rows: such a code maps none of them.

    Codes are counted first (combined map-side), and only the repeated ones are joined back.
    """
    repeated = rows.filter(F.col("code") != "").groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    return rows.join(repeated.select("code", F.lit(True).alias("repeated")), "code", "left").withColumn(
        "repeated", F.coalesce("repeated", F.lit(False)))


def classify(rows: DataFrame) -> DataFrame:
    """(code, isin, sector, name, symbol) -> group and class of every row."""
    marked = exclude_duplicate_codes(rows)
    proposed = instrument_group(F.col("isin"), F.col("sector"), F.col("name"), F.col("symbol"))
    grouped = marked.withColumn("group", F.when(F.col("code") == "", NO_CODE).when(F.col("repeated"), DUPLICATE_CODE).otherwise(proposed))
    return grouped.withColumn("class", F.coalesce(group_class(F.col("group")), F.lit("unknown")))


def instrument_map(classified: DataFrame) -> DataFrame:
    """The proposed ins_code -> class map."""
    return classified.filter(F.col("class") != "unknown").select(F.col("code").alias("ins_code"), "class")


def group_stats(classified: DataFrame, samples: int = 5) -> DataFrame:
    """Rows per group, its class, and up to five sample symbols of unmapped groups (the first ones by row).

    The samples come from a bounded aggregate: each symbol row is ranked inside its group only among the
    ``samples`` smallest row numbers each task keeps.
    """
    counts = classified.groupBy("group").agg(F.count(F.lit(1)).alias("rows"), F.max("class").alias("class"))
    unmapped = classified.filter(F.col("class") == "unknown").select("group", "row", "symbol")
    picked = smallest_per_group(unmapped, ["group"], F.struct("row", "symbol"), samples)
    names = picked.groupBy("group").agg(F.sort_array(F.collect_list("item")).alias("s")).select(
        "group", F.array_join(F.transform("s", lambda x: x["symbol"]), "، ").alias("samples"))
    return counts.join(names, "group", "left")


def smallest_per_group(rows: DataFrame, keys: list[str], item: Column, n: int) -> DataFrame:
    """The ``n`` smallest items of every group. The planner limits each task's rows of a group to ``n`` before the shuffle (WindowGroupLimit)."""
    whole = W.partitionBy(*keys).orderBy("item")
    return rows.select(*keys, item.alias("item")).withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= n).select(*keys, "item")


def class_counts(classified: DataFrame) -> DataFrame:
    return classified.groupBy("class").agg(F.count(F.lit(1)).alias("rows"))


def duplicate_codes(rows: DataFrame) -> DataFrame:
    return rows.filter(F.col("code") != "").groupBy("code").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
