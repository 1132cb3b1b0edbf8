"""Registered queries over two vendor feeds: parsing, matching, comparison and classification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions import text as tx
from tapeloom.operators import classmap, vendors
from tapeloom.plans import tape_sql
from tapeloom.plans.inputs import shared
from tapeloom.plans.registry import Registry
from tapeloom.runtime import prepare
from tapeloom.sources import bindings, vendor_feeds


class Feeds:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = prepare(spark), sf_dir

    def _shared(self, name: str, build: Callable[[], DataFrame]) -> DataFrame:
        return shared(self.spark, self.sf_dir, name, ["part"], build)

    def _rows(self, payloads: DataFrame) -> DataFrame:
        """Rows of every payload, keyed by payload number and position (an array position, so below 2^31)."""
        rows = vendor_feeds.payload_rows(payloads)
        return rows.withColumn("row", F.shiftleft("payload_no", 32) + F.col("row")).drop("payload_no")

    @property
    def a(self) -> DataFrame:
        return self._shared("feed-a", lambda: self._rows(bindings.payloads_a(self.spark, self.sf_dir)))

    @property
    def b(self) -> DataFrame:
        return self._shared("feed-b", lambda: self._rows(bindings.payloads_b(self.spark, self.sf_dir)))

    @property
    def ids_a(self) -> DataFrame:
        return vendors.identities(self.a, vendors.KEYS_A)

    @property
    def ids_b(self) -> DataFrame:
        return vendors.identities(self.b, vendors.KEYS_B)

    def both(self, query: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """``query`` of the identities of each feed."""
        return query(self.ids_a).withColumn("vendor", F.lit("a")).unionByName(query(self.ids_b).withColumn("vendor", F.lit("b")))

    @property
    def pairs(self) -> DataFrame:
        return self._shared("vendor-pairs", lambda: vendors.match(self.ids_a, self.ids_b))

    @property
    def values(self) -> DataFrame:
        """Every cell of every pair, parsed once for all reports on it."""
        return self._shared("vendor-values", lambda: self.some_values(None))

    def some_values(self, only: list[str] | None) -> DataFrame:
        return vendors.field_values(vendors.pair_rows(self.pairs, self.a, self.b), only)

    @property
    def classified(self) -> DataFrame:
        """Feed B's rows with their proposed group and class."""
        rows = self.b.select("row", tx.text(F.col("raw")["instance_code"]).alias("code"), *[
            tx.text(F.col("raw")[k]).alias(n) for n, k in (("isin", "namad_code"), ("sector", "industry_code"), ("name", "full_name"), ("symbol", "name"))])
        return classmap.classify(rows)


# --- SQL -------------------------------------------------------------------------------------------
_LIST = "[" + ", ".join(f"'{p}'" for p in bindings._PREFIXES) + "]"
_FUNDS = "[" + ", ".join(f"'{p}'" for p in bindings._FUNDS) + "]"
_COMMODITY = "[" + ", ".join(f"'{p}'" for p in bindings._COMMODITY) + "]"
PARTS = f"""
vp AS (
  SELECT *, v // 5 * (pk % 5) AS ib, v // 4 * (pk % 4) AS isell, v * price AS val,
    {_LIST}[CAST(pk % 9 + 1 AS INT)] || lpad(CAST(pk % 10000 AS VARCHAR), 4, '0') || CASE WHEN pk % 37 = 0 THEN '0002' ELSE '0001' END AS isin,
    CASE WHEN pk % 9 = 7 THEN 68 WHEN pk % 9 = 4 THEN 69 ELSE pk % 60 END AS sector,
    CASE WHEN pk % 9 = 7 THEN {_FUNDS}[CAST(pk % 4 + 1 AS INT)] WHEN pk % 9 = 5 THEN {_COMMODITY}[CAST(pk % 3 + 1 AS INT)] ELSE 'شرکت' || pk END AS title
  FROM (SELECT p_partkey AS pk, p_name, p_size * 1000 + p_partkey % 97 AS price, p_partkey % 13 * 1000 AS v,
          CASE WHEN p_partkey % 31 = 0 THEN p_name ELSE p_name || p_partkey END AS base FROM part)),
va AS (
  SELECT pk, CAST(1000000 + pk - CASE WHEN pk % 29 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS code, 'کی' || base AS symbol, 'کی' || replace(base, ' ', '') AS folded,
    isin, CAST(sector AS VARCHAR) AS sector, title AS name, price, v, val, ib, isell FROM vp),
vb AS (
  SELECT pk, CASE WHEN pk % 23 = 0 THEN '' ELSE CAST(1000000 + pk AS VARCHAR) END AS code, 'كي ' || base AS symbol, 'کی' || replace(base, ' ', '') AS folded,
    isin, lpad(CAST(sector AS VARCHAR), 4, '0') AS sector,
    CASE WHEN pk % 9 = 7 AND pk % 10 = 3 THEN 'صندوق' ELSE replace(title, 'ی', 'ي') END AS name, price, v, val, ib, isell
  FROM vp WHERE pk % 11 <> 0),
cpairs AS (
  SELECT a.pk AS pa, b.pk AS pb, false AS by_name, a.code AS key
  FROM (SELECT * FROM va QUALIFY count(*) OVER (PARTITION BY code) = 1) a
  JOIN (SELECT * FROM vb WHERE code <> '' QUALIFY count(*) OVER (PARTITION BY code) = 1) b ON a.code = b.code),
lefta AS (SELECT *, count(*) OVER (PARTITION BY folded) AS n FROM va WHERE pk NOT IN (SELECT pa FROM cpairs)),
leftb AS (SELECT *, count(*) OVER (PARTITION BY folded) AS n FROM vb WHERE pk NOT IN (SELECT pb FROM cpairs)),
outcomes AS (
  SELECT a.folded, max(a.n) AS n_a, max(b.n) AS n_b, CASE WHEN max(a.n) > 1 OR max(b.n) > 1 THEN 'ambiguous' WHEN max(a.code) <> '' AND max(b.code) <> '' THEN 'id_conflict'
    ELSE 'pair' END AS outcome, min(a.pk) AS pa, min(b.pk) AS pb FROM lefta a JOIN leftb b USING (folded) GROUP BY a.folded),
vpairs AS (SELECT pa, pb, by_name, key FROM cpairs UNION ALL SELECT pa, pb, true, folded FROM outcomes WHERE outcome = 'pair')"""

# (field, state and value of A, state and value of B); a field bound on neither side is absent on both
_CELLS = {
    "symbol": ("'ok'", "a.folded", "'ok'", "b.folded"), "isin": ("'ok'", "a.isin", "'ok'", "b.isin"),
    "sector_code": ("'ok'", "CAST(a.sector AS BIGINT)", "'ok'", "CAST(b.sector AS BIGINT)"),
    "price_last": ("'ok'", "CASE WHEN a.pk % 61 = 0 THEN 1 ELSE a.price END", "'ok'", "b.price + CASE WHEN b.pk % 17 = 0 THEN 1 ELSE 0 END"),
    "price_close": ("'ok'", "a.price", "CASE WHEN b.pk % 41 = 0 THEN 'bad' ELSE 'ok' END", "b.price"),
    "price_yesterday": ("'ok'", "a.price - 5", "CASE WHEN b.pk % 43 = 0 THEN 'bad' ELSE 'ok' END", "b.price - 5"),
    "price_limit_min": ("'ok'", "CASE WHEN a.pk % 45 = 0 THEN 1 ELSE a.price - 100 END", "'ok'", "b.price - 100"),
    "price_limit_max": ("'ok'", "CASE WHEN a.pk % 47 = 0 THEN 999999999 ELSE a.price + 100 END", "CASE WHEN b.pk % 53 = 0 THEN 'bad' ELSE 'ok' END", "b.price + 100"),
    "trade_count": ("'ok'", "a.pk % 50", "CASE WHEN b.pk % 19 = 0 THEN 'absent' ELSE 'ok' END", "b.pk % 50"),
    "volume": ("'ok'", "a.v", "'ok'", "b.v + CASE WHEN b.pk % 59 = 0 THEN 1000 ELSE 0 END"), "value": ("'ok'", "a.val", "'ok'", "b.val"),
    "ind_buy_vol": ("'ok'", "a.ib", "'ok'", "b.ib"), "inst_buy_vol": ("'ok'", "a.v - a.ib + CASE WHEN a.pk % 27 = 0 THEN 7 ELSE 0 END", "'ok'", "b.v - b.ib"),
    "ind_sell_vol": ("'ok'", "a.isell", "'ok'", "b.isell"),
    "inst_sell_vol": ("CASE WHEN a.pk % 33 = 0 THEN 'absent' ELSE 'ok' END", "a.v - a.isell", "'ok'", "b.v - b.isell"),
}


# how each bound field is written, where it is not a plain number (A) or a plain numeric string (B)
_FORMATS_A = {"symbol": "'text'", "isin": "'text'", "inst_sell_vol": "CASE WHEN a.pk % 33 = 0 THEN 'null' ELSE 'integer number' END"}
_FORMATS_B = {
    "symbol": "'text'", "isin": "'text'", "price_close": "CASE WHEN b.pk % 41 = 0 THEN 'text' ELSE 'decimal string' END",
    "price_yesterday": "CASE WHEN b.pk % 43 = 0 THEN 'Persian digits' ELSE 'numeric string' END", "price_limit_min": "'decimal string'",
    "price_limit_max": "'decimal string'", "trade_count": "CASE WHEN b.pk % 19 = 0 THEN 'empty string' ELSE 'numeric string' END",
    "volume": "CASE WHEN b.v + CASE WHEN b.pk % 59 = 0 THEN 1000 ELSE 0 END = 0 THEN 'numeric string' ELSE 'numeric string with separators' END",
}


def _cell_rows() -> str:
    out = []
    for group, name, *_ in vendors.FIELDS:
        sa, a, sb, b = _CELLS.get(name, ("'absent'", "NULL", "'absent'", "NULL"))
        out.append(f"SELECT '{group}' AS \"group\", '{name}' AS field, p.by_name, p.key, a.symbol, {sa} AS sa, CAST({a} AS VARCHAR) AS xa, {sb} AS sb, "
                   f"CAST({b} AS VARCHAR) AS xb, a.pk FROM vpairs p JOIN va a ON a.pk = p.pa JOIN vb b ON b.pk = p.pb")
    return " UNION ALL ".join(out)


CELLS = f"""
cells AS (
  SELECT *, CASE WHEN sa = 'ok' AND sb = 'ok' THEN CASE WHEN xa = xb THEN 'match' ELSE 'mismatch' END WHEN (sa = 'ok' AND sb = 'bad') OR (sa = 'bad' AND sb = 'ok') THEN 'mismatch'
    WHEN sa = 'ok' THEN 'only_a' WHEN sb = 'ok' THEN 'only_b' WHEN sa = 'absent' AND sb = 'absent' THEN 'neither' ELSE 'both_bad' END AS kind
  FROM ({_cell_rows()})),
fstats AS (
  SELECT "group", field, count(*) FILTER (sa = 'ok' AND sb = 'ok') AS "both", count(*) FILTER (kind = 'match') AS match,
    count(*) FILTER (kind = 'match' AND xa <> '0') AS nonzero_match, count(*) FILTER (kind = 'mismatch') AS mismatch, count(*) FILTER (kind = 'only_a') AS only_a,
    count(*) FILTER (kind = 'only_b') AS only_b, count(*) FILTER (kind = 'neither') AS neither, count(*) FILTER (kind = 'both_bad') AS both_bad,
    count(*) FILTER (sa = 'bad') AS bad_a, count(*) FILTER (sb = 'bad') AS bad_b FROM cells GROUP BY ALL)"""


def group_sql(isin: str, sector: str, name: str, symbol: str) -> str:
    c = classmap
    n = f"translate({name}, 'يىك', 'ییک')"
    s = f"translate({symbol}, 'يىك ', 'ییک')"
    return f"""CASE WHEN length({isin}) = 12 AND {isin}[9:12] IN ('0002', '0003', '0004') THEN '{c.ABNORMAL}' || {isin}[9:12] || ')'
  WHEN starts_with({isin}, 'IRE9') THEN '{c.ENERGY}' WHEN starts_with({isin}, 'IRR') THEN '{c.RIGHTS}'
  WHEN ltrim({sector}, '0') = '69' OR regexp_matches({isin}, '^IRB[0-9]') THEN '{c.BOND}'
  WHEN starts_with({isin}, 'IRTK') THEN CASE WHEN {s} IN ('پلاتا', 'سافرون') OR contains({n}, 'زعفران') THEN '{c.OTHER_COMMODITY}'
    WHEN contains({n}, 'نقره') OR starts_with({s}, 'نقر') OR starts_with({s}, 'سیلو') THEN '{c.SILVER_FUND}' ELSE '{c.GOLD_FUND}' END
  WHEN ltrim({sector}, '0') = '68' THEN CASE WHEN ends_with({n}, '-د') OR ends_with({n}, 'ثابت') OR contains({n}, 'درآمد ثابت') OR contains({n}, 'درآمدثابت') THEN '{c.FIXED_FUND}'
    WHEN ends_with({n}, '-س') OR ends_with({n}, '-ب') OR contains({n}, 'سهام') OR contains({n}, 'شاخصی') OR contains({n}, 'بخشی') OR contains({n}, 'اهرم') THEN '{c.EQUITY_FUND}'
    ELSE '{c.OTHER_FUND}' END
  WHEN starts_with({isin}, 'IRO1') THEN '{c.MAIN_MARKET}' WHEN starts_with({isin}, 'IRO3') THEN '{c.SECOND_MARKET}'
  WHEN starts_with({isin}, 'IRO7') OR starts_with({isin}, 'IRO5') THEN '{c.BASE_MARKET}' ELSE '{c.NO_GROUP}' END"""


_CLASS = " ".join(f"WHEN '{g}' THEN '{c}'" for g, c in classmap.CLASS_OF_GROUP.items())
GROUPS = f"""
ga AS (SELECT pk, {group_sql('isin', 'sector', 'name', 'symbol')} AS grp FROM va),
gb AS (SELECT pk, {group_sql('isin', 'sector', 'name', 'symbol')} AS grp FROM vb),
gpairs AS (SELECT ga.grp AS group_a, gb.grp AS group_b FROM vpairs p JOIN ga ON ga.pk = p.pa JOIN gb ON gb.pk = p.pb)"""
CLASSIFIED = f"""
classified AS (
  SELECT *, coalesce(CASE grp {_CLASS} END, 'unknown') AS class FROM (
    SELECT vb.*, CASE WHEN code = '' THEN '{classmap.NO_CODE}' WHEN count(*) OVER (PARTITION BY code) > 1 THEN '{classmap.DUPLICATE_CODE}' ELSE gb.grp END AS grp
    FROM vb JOIN gb USING (pk)))"""


def register(r: Registry) -> None:
    def add(name: str, build: Callable[[Feeds], DataFrame], parts: list[str] | None = None, select: str | None = None) -> None:
        r.add(name, lambda spark, sf_dir: build(Feeds(spark, sf_dir)), tape_sql.with_(parts, select) if select else None)

    _ingest(add)
    _matching(add)
    _comparison(add)
    _classes(add)




def _ingest(add) -> None:
    columns = ["ins_code", "symbol", "price_last", "price_close", "price_yesterday", "price_limit_min", "price_limit_max", "trade_count", "volume", "value",
               "ind_buy_vol", "inst_buy_vol", "ind_sell_vol", "inst_sell_vol"]

    def shown(df: DataFrame) -> DataFrame:
        return df.select(*columns, "ingest_time", F.array_join("missing", ",").alias("missing"))

    def left_out(f: Feeds) -> DataFrame:
        def of(payloads: DataFrame, vendor: str) -> DataFrame:
            return vendor_feeds.rejected(payloads).select(F.lit(vendor).alias("vendor"), "payload_no", "row", "reason", F.col("payload").alias("text"))

        return of(bindings.payloads_a(f.spark, f.sf_dir), "a").unionByName(of(bindings.payloads_b(f.spark, f.sf_dir), "b"))

    add("rejected_payloads", left_out, [PARTS], """SELECT vendor, no AS payload_no, x.row, x.reason, x.text FROM (
  SELECT 'a' AS vendor, pk // 100 AS no, count(*) AS n FROM va GROUP BY ALL UNION ALL SELECT 'b', pk // 100, count(*) FROM vb GROUP BY ALL) p
JOIN (VALUES (0, 'element is not a JSON object', '7'), (2, 'element is not a JSON object', '"x"'), (3, 'element is not a JSON object', '[{"id":1,"l18":"in a list"}]'),
  (NULL, 'payload is not a JSON array', '{"successful":false,"rows":[{"id":1}]}')) v(k, reason, text) ON CASE WHEN k IS NULL THEN no % 4 = 0 ELSE no % 3 = 0 END
CROSS JOIN LATERAL (SELECT n + k AS row, reason, text) x""")
    add("ingest_feed_a", lambda f: shown(vendor_feeds.ingest_a(f.a)), [PARTS], """SELECT code AS ins_code, symbol, CASE WHEN pk % 61 <> 0 THEN price END AS price_last,
  price AS price_close, price - 5 AS price_yesterday, CASE WHEN ok THEN price - 100 END AS price_limit_min, CASE WHEN ok THEN price + 100 END AS price_limit_max,
  pk % 50 AS trade_count, v AS volume, CASE WHEN NOT void THEN val END AS value, ib AS ind_buy_vol, v - ib + CASE WHEN pk % 27 = 0 THEN 7 ELSE 0 END AS inst_buy_vol,
  isell AS ind_sell_vol, CASE WHEN pk % 33 <> 0 THEN v - isell END AS inst_sell_vol, make_timestamp((1704096000 + pk // 100) * 1000000) AS ingest_time,
  CASE WHEN pk % 61 = 0 THEN 'price_last,' ELSE '' END || 'price_first,price_min,price_max,' || CASE WHEN pk % 33 = 0 THEN 'inst_sell_vol,' ELSE '' END ||
    'ind_buy_count,inst_buy_count,ind_sell_count,inst_sell_count,' || CASE WHEN void THEN 'value,' ELSE '' END || CASE WHEN NOT ok THEN 'price_limits,' ELSE '' END || 'book' AS missing
FROM (SELECT *, pk % 61 = 0 AND v > 0 AS void, pk % 45 <> 0 AND pk % 47 <> 0 AND price - 100 > 1 AS ok FROM va)""")
    add("ingest_feed_b", lambda f: shown(vendor_feeds.ingest_b(f.b)), [PARTS], """SELECT code AS ins_code, symbol, price + CASE WHEN pk % 17 = 0 THEN 1 ELSE 0 END AS price_last,
  CASE WHEN false THEN price END AS price_close, CASE WHEN pk % 43 <> 0 THEN price - 5 END AS price_yesterday, CASE WHEN ok THEN price - 100 END AS price_limit_min,
  CASE WHEN ok THEN price + 100 END AS price_limit_max, CASE WHEN pk % 19 <> 0 THEN pk % 50 END AS trade_count, v + CASE WHEN pk % 59 = 0 THEN 1000 ELSE 0 END AS volume, val AS value,
  ib AS ind_buy_vol, v - ib AS inst_buy_vol, isell AS ind_sell_vol, v - isell AS inst_sell_vol, make_timestamp((1704096000 + pk // 100) * 1000000) AS ingest_time,
  'price_close,price_first,price_max,price_min,' || CASE WHEN pk % 43 = 0 THEN 'price_yesterday,' ELSE '' END || CASE WHEN pk % 19 = 0 THEN 'trade_count,' ELSE '' END ||
    'ind_buy_count,ind_sell_count,inst_buy_count,inst_sell_count,' || CASE WHEN NOT ok THEN 'price_limits,' ELSE '' END || 'book' AS missing
FROM (SELECT *, pk % 53 <> 0 AS ok FROM vb WHERE code <> '')""")

    def types(f: Feeds) -> DataFrame:
        """Two request types of feed A: large parts first, then every part."""
        parts = bindings.table(f.spark, f.sf_dir, "part").select(
            (F.col("p_partkey") % 700).cast("string").alias("ins_code"), F.col("p_partkey").alias("row"), F.col("p_size").cast("bigint").alias("size"))
        both = parts.filter("size > 25").withColumn("type_pos", F.lit(0)).unionByName(parts.withColumn("type_pos", F.lit(1)))
        return vendor_feeds.union_payload_types(both).select("ins_code", "type_pos", "row", "size")

    add("union_payload_types", types, ["t AS (SELECT CAST(p_partkey % 700 AS VARCHAR) AS ins_code, p_partkey AS row_, CAST(p_size AS BIGINT) AS size FROM part)"],
        """SELECT ins_code, type_pos, row_ AS "row", size FROM (SELECT *, 0 AS type_pos FROM t WHERE size > 25 UNION ALL SELECT *, 1 FROM t)
QUALIFY row_number() OVER (PARTITION BY ins_code ORDER BY type_pos, row_) = 1""")

    def scalars(f: Feeds) -> DataFrame:
        """The parsing functions over every token of feed B."""
        s = F.col("text")
        texts = f.b.select(F.explode("raw").alias("key", "token")).select(tx.text(F.col("token")).alias("text"))
        return texts.select("text", tx.num(s).alias("num"), tx.whole_decimal(s).alias("whole"), tx.parse_int3(s)["state"].alias("state"),
                            tx.loose_integer(s).alias("parsed"), tx.instrument_code(s).alias("code"), tx.fold_name(s).alias("folded")).groupBy(
            "text", "num", "whole", "state", "parsed", "code", "folded").agg(F.count(F.lit(1)).alias("n"))

    texts = ["CASE WHEN pk % 23 = 0 THEN '' ELSE code END", "symbol", "name", "isin", "sector", "CAST(price + CASE WHEN pk % 17 = 0 THEN 1 ELSE 0 END AS VARCHAR)",
             "CASE WHEN pk % 41 = 0 THEN 'n/a' ELSE price || '.00' END", "CASE WHEN pk % 43 = 0 THEN '۱۲' ELSE CAST(price - 5 AS VARCHAR) END", "(price - 100) || '.00'",
             "(price + 100) || CASE WHEN pk % 53 = 0 THEN '.50' ELSE '.00' END", "CASE WHEN pk % 19 = 0 THEN '' ELSE CAST(pk % 50 AS VARCHAR) END",
             "CASE WHEN v + CASE WHEN pk % 59 = 0 THEN 1000 ELSE 0 END = 0 THEN '0' ELSE ((v + CASE WHEN pk % 59 = 0 THEN 1000 ELSE 0 END) // 1000) || ',000' END",
             "CAST(val AS VARCHAR)", "CAST(ib AS VARCHAR)", "CAST(v - ib AS VARCHAR)", "CAST(isell AS VARCHAR)", "CAST(v - isell AS VARCHAR)",
             "'1403/' || (1 + pk % 12) || '/' || (1 + pk % 29)", "(9 + pk % 4) || ':05:00'", "CASE WHEN pk % 3 = 0 THEN 'A' ELSE '' END"]
    add("vendor_values", scalars, [PARTS, "tk AS (" + " UNION ALL ".join(f"SELECT {t} AS s FROM vb" for t in texts) + ")", r"""
ts AS (SELECT s, replace(s, ',', '') AS plain, regexp_replace(s, '\.0*$', '') AS cut, regexp_replace(replace(s, ',', ''), '^([^.]+)\.0*$', '\1') AS bare FROM tk)"""],
        r"""SELECT s AS text, CASE WHEN regexp_matches(plain, '^[+-]?[0-9]+$') THEN TRY_CAST(plain AS BIGINT) END AS num,
  CASE WHEN regexp_matches(cut, '^[+-]?[0-9]+$') THEN TRY_CAST(cut AS BIGINT) END AS whole,
  CASE WHEN plain IN ('', '-') THEN 'absent' WHEN regexp_matches(bare, '^[+-]?[0-9]+$') AND TRY_CAST(bare AS BIGINT) IS NOT NULL THEN 'ok' ELSE 'bad' END AS state,
  CASE WHEN regexp_matches(bare, '^[+-]?[0-9]+$') THEN TRY_CAST(bare AS BIGINT) END AS parsed, CASE WHEN regexp_matches(s, '^[0-9]+$') THEN s END AS code,
  translate(s, 'يىك ', 'ییک') AS folded, count(*) AS n FROM ts GROUP BY ALL""")


def _repeats(key: str) -> str:
    return " UNION ALL ".join(f"SELECT '{v}' AS vendor, {key}, count(*) AS n FROM {cte} WHERE {key} <> '' GROUP BY {key} HAVING count(*) > 1"
                              for v, cte in (("a", "va"), ("b", "vb")))


def _matching(add) -> None:
    add("vendor_pairs_by_code", lambda f: vendors.match_by_code(f.ids_a, f.ids_b).select("code"), [PARTS], "SELECT key AS code FROM cpairs")
    add("vendor_repeated_codes", lambda f: f.both(vendors.repeated_codes), [PARTS], _repeats("code"))

    def by_symbol(f: Feeds) -> DataFrame:
        coded = vendors.match_by_code(f.ids_a, f.ids_b)
        return vendors.symbol_outcomes(vendors.leftovers(f.ids_a, coded, "a"), vendors.leftovers(f.ids_b, coded, "b")).select("folded", "n_a", "n_b", "outcome")

    add("vendor_symbol_outcomes", by_symbol, [PARTS], "SELECT folded, n_a, n_b, outcome FROM outcomes")
    add("vendor_pairs", lambda f: f.pairs.select("by_name", "key"), [PARTS], "SELECT by_name, key FROM vpairs")
    for side, cte in (("a", "va"), ("b", "vb")):
        add(f"vendor_only_{side}", lambda f, side=side: vendors.leftovers(f.ids_a if side == "a" else f.ids_b, f.pairs, side).select(
            F.coalesce("code", F.lit("")).alias("code"), "folded"), [PARTS], f"SELECT code, folded FROM {cte} WHERE pk NOT IN (SELECT p{side} FROM vpairs)")
    add("vendor_duplicate_symbols", lambda f: f.both(vendors.duplicate_symbols), [PARTS], _repeats("folded"))
    add("vendor_latest_times", lambda f: vendors.latest_time(f.a, None, "time").withColumn("vendor", F.lit("a")).unionByName(
        vendors.latest_time(f.b, "last_trade_date", "last_trade_time").withColumn("vendor", F.lit("b"))), [PARTS],
        """SELECT 'a' AS vendor, max(lpad(CAST(9 + pk % 4 AS VARCHAR), 2, '0') || ':' || lpad(CAST(pk % 60 AS VARCHAR), 2, '0') || ':00') AS latest FROM va
UNION ALL (SELECT 'b', '1403/' || (1 + pk % 12) || '/' || (1 + pk % 29) || ' ' || (9 + pk % 4) || ':05:00' FROM vb
  ORDER BY 1 + pk % 12 DESC, 1 + pk % 29 DESC, 9 + pk % 4 DESC LIMIT 1)""")


def _comparison(add) -> None:
    counts = ["match", "nonzero_match", "mismatch", "only_a", "only_b", "neither", "both_bad", "bad_a", "bad_b"]
    add("vendor_field_stats", lambda f: vendors.field_stats(f.values), [PARTS, CELLS],
        f'SELECT "group", field, "both", {", ".join(counts)} FROM fstats')
    encodings = " UNION ALL ".join(
        f"SELECT '{name}' AS field, {_FORMATS_A.get(name, number)} AS fa, {_FORMATS_B.get(name, string)} AS fb FROM vpairs p JOIN va a ON a.pk = p.pa JOIN vb b ON b.pk = p.pb"
        for _, name, *_ in vendors.FIELDS for number, string in [("'integer number'", "'numeric string'") if name in _CELLS else ("'absent'", "'absent'")])
    add("vendor_field_formats", lambda f: vendors.field_formats(f.values), [PARTS, f"enc AS ({encodings})"],
        """SELECT field, vendor, format, count(*) AS n FROM (SELECT field, 'a' AS vendor, fa AS format FROM enc UNION ALL SELECT field, 'b', fb FROM enc) GROUP BY ALL""")
    add("vendor_mismatch_examples", lambda f: vendors.mismatch_examples(f.values), [PARTS, CELLS],
        """SELECT field, key, symbol || ': ' || xa || ' ≠ ' || CASE WHEN sb = 'ok' THEN xb WHEN field = 'price_close' THEN 'n/a' WHEN field = 'price_yesterday' THEN '۱۲'
  ELSE xb || '.50' END AS example FROM cells WHERE kind = 'mismatch' QUALIFY row_number() OVER (PARTITION BY field ORDER BY by_name, key) <= 3""")
    add("vendor_extra_keys", lambda f: vendors.extra_keys(f.a, f.b), [PARTS],
        """SELECT DISTINCT 'a' AS vendor, unnest(['l30', 'time', 'base_volume']) AS key FROM va
UNION ALL SELECT DISTINCT 'b', unnest(['full_name', 'last_trade_date', 'last_trade_time', 'state']) FROM vb""")
    add("vendor_mismatch_by_group", lambda f: vendors.mismatch_by_group(vendors.field_stats(f.values)), [PARTS, CELLS],
        'SELECT "group", CAST(sum(mismatch) AS BIGINT) AS n FROM fstats GROUP BY "group" HAVING sum(mismatch) > 0')

    def static(f: Feeds) -> DataFrame:
        """Judged at noon Tehran."""
        return vendors.static_mismatch(vendors.field_stats(f.some_values(vendors.STATIC_FIELDS)), F.expr("TIMESTAMP'2024-01-01 08:30:00'"))

    add("vendor_static_mismatch", static, [PARTS, CELLS],
        f"SELECT field, mismatch AS n FROM fstats WHERE mismatch > 0 AND field IN ({', '.join(repr(x) for x in vendors.STATIC_FIELDS)})")
    add("vendor_volume_ahead", lambda f: vendors.volume_ahead(f.some_values(["volume"])), [PARTS, CELLS], """SELECT CASE WHEN sa <> 'ok' OR sb <> 'ok' THEN 'missing'
  WHEN xa = '0' AND xb = '0' THEN 'both_zero' WHEN CAST(xa AS BIGINT) > CAST(xb AS BIGINT) THEN 'a' WHEN CAST(xb AS BIGINT) > CAST(xa AS BIGINT) THEN 'b' ELSE 'equal' END AS ahead,
  count(*) AS n FROM cells WHERE field = 'volume' GROUP BY 1""")
    add("vendor_side_checks", lambda f: vendors.side_checks(f.a, "a").unionByName(vendors.side_checks(f.b, "b")), [PARTS],
        """SELECT 'a' AS vendor, count(*) AS traded, count(*) FILTER (pk % 33 <> 0 AND pk % 27 = 0) AS side_mismatch, count(*) FILTER (pk % 33 = 0) AS side_missing FROM va WHERE v > 0
UNION ALL SELECT 'b', count(*), count(*) FILTER (pk % 59 = 0), 0 FROM vb WHERE v + CASE WHEN pk % 59 = 0 THEN 1000 ELSE 0 END > 0""")


def _classes(add) -> None:
    add("vendor_group_counts", lambda f: vendors.group_counts(f.ids_a, f.ids_b, f.pairs), [PARTS, GROUPS], """SELECT g.grp AS "group",
  (SELECT count(*) FROM ga WHERE ga.grp = g.grp) AS rows_a, (SELECT count(*) FROM gb WHERE gb.grp = g.grp) AS rows_b,
  (SELECT count(*) FROM gpairs WHERE group_a = g.grp AND group_b = g.grp) AS joined_same FROM (SELECT grp FROM ga UNION SELECT grp FROM gb) g""")
    add("vendor_group_transitions", lambda f: vendors.group_transitions(f.ids_a, f.ids_b, f.pairs), [PARTS, GROUPS],
        "SELECT group_a || ' → ' || group_b AS transition, count(*) AS n FROM gpairs WHERE group_a <> group_b GROUP BY 1")
    base = [PARTS, GROUPS, CLASSIFIED]
    add("instrument_groups", lambda f: f.classified.select("code", "symbol", "group", "class"), base, 'SELECT code, symbol, grp AS "group", class FROM classified')
    add("instrument_class_map", lambda f: classmap.instrument_map(f.classified), base, "SELECT code AS ins_code, class FROM classified WHERE class <> 'unknown'")
    add("class_map_counts", lambda f: classmap.class_counts(f.classified), base, "SELECT class, count(*) AS rows FROM classified GROUP BY class")
    add("class_map_groups", lambda f: classmap.group_stats(f.classified), base, """SELECT grp AS "group", count(*) AS rows, max(class) AS class,
  CASE WHEN max(class) = 'unknown' THEN array_to_string(list_slice(list(trim(symbol) ORDER BY pk), 1, 5), '، ') END AS samples FROM classified GROUP BY grp""")
    add("class_map_duplicate_codes", lambda f: f.both(lambda ids: classmap.duplicate_codes(ids.select(F.coalesce("code", F.lit("")).alias("code")))), [PARTS],
        _repeats("code"))
