"""Golden cases of vendor parsing, matching, comparison and classification."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import text as tx
from tapeloom.operators import classmap, vendors
from tapeloom.sources import vendor_feeds


def feed(spark, objects: list[dict | str]):
    body = "[" + ",".join(o if isinstance(o, str) else json.dumps(o, ensure_ascii=False) for o in objects) + "]"
    payloads = spark.createDataFrame([(body,)], "payload string").withColumn("ingest_time", F.expr("TIMESTAMP'2026-09-26 06:00:00'"))
    return vendor_feeds.payload_rows(payloads)


ENCODINGS = [
    ('5', "ok", "5", "integer number"), ('"5"', "ok", "5", "numeric string"), ('"1,234"', "ok", "1234", "numeric string with separators"),
    ('"71690.00"', "ok", "71690", "decimal string"), ('71690.00', "ok", "71690", "decimal number"), ('12.5', "bad", None, "decimal number"), ('"12.50"', "bad", None, "decimal string"),
    ('""', "absent", None, "empty string"), ('"-"', "absent", None, "text"), ('null', "absent", None, "null"), ('"abc"', "bad", None, "text"),
    ('"۱۲"', "bad", None, "Persian digits"), ('99999999999999999999', "bad", None, "integer number"), ('72044846109864381', "ok", "72044846109864381", "integer number")]


def test_value_encodings(spark):
    rows = feed(spark, ["{" + f'"v": {raw}' + "}" for raw, *_ in ENCODINGS])
    rows = rows.withColumn("t", F.col("raw")["v"]).withColumn("s", tx.text(F.col("t"))).withColumn("x", tx.parse_int3(F.col("s")))
    got = [(r.x.state, r.x.value, r.f) for r in rows.withColumn("f", tx.value_format(F.col("t"), F.col("s"))).orderBy("row").collect()]
    assert got == [(state, value, fmt) for _, state, value, fmt in ENCODINGS]


def test_payload_that_is_not_an_array(spark):
    df = spark.createDataFrame([('{"error": 1}',), ("oops",), ('[{"a": "x{,}\\"y"}]',)], "payload string")
    assert vendor_feeds.bad_payloads(df).count() == 2
    assert vendor_feeds.payload_rows(df).select(tx.text(F.col("raw")["a"])).collect()[0][0] == 'x{,}"y'


def test_nested_values_and_repeated_keys(spark):
    """The last of repeated keys counts; nested values are one token; elements that are no objects are set aside."""
    body = ('[{"id": 1, "pl": 5, "x": {"id": 9, "t": "}],{", "k": [1, {"a": null}]}, "pl": "7.50", "n": 1e5, "w": 12.00, "b": true, "big": 72044846109864381},'
            ' 5, {"id": 2, "l": {"k": 1, "k": 2}}, null, "s", [{"id": 3}], {}]')
    df = spark.createDataFrame([(0, body), (1, "[{"), (2, None), (3, "[]"), (4, '{"id": 4}')], "n int, payload string")
    rows = {(r.n, r.row): r.raw for r in vendor_feeds.payload_rows(df).collect()}
    assert sorted(rows) == [(0, 0), (0, 2), (0, 6)]
    assert rows[0, 0] == {"id": "1", "pl": '"7.50"', "x": '{"id":9,"k":[1,{"a":null}],"t":"}],{"}', "n": "100000.0E0", "w": "12.0", "b": "true", "big": "72044846109864381"}
    assert rows[0, 2]["l"] == '{"k":2}' and rows[0, 6] == {}
    left = {(r.n, r.row, r.payload) for r in vendor_feeds.rejected(df).collect()}
    assert left == {(0, 1, "5"), (0, 4, '"s"'), (0, 5, '[{"id":3}]'), (1, None, "[{"), (2, None, None), (4, None, '{"id": 4}')}
    read = vendor_feeds.payload_rows(df).select(*[tx.num(tx.text(F.col("raw")[k])).alias(k) for k in ("n", "w", "big")]).first()
    assert (read.n, read.w, read.big) == (None, None, 72044846109864381)


def match(spark, a, b):
    fa, fb = feed(spark, a), feed(spark, b)
    return fa, fb, vendors.identities(fa, vendors.KEYS_A), vendors.identities(fb, vendors.KEYS_B)


def test_matching(spark):
    a = [{"id": 12, "l18": "شپنا"}, {"id": 3, "l18": "خودرو"}, {"id": 5, "l18": "الف"}, {"id": 5, "l18": "ب"}, {"id": "x", "l18": "Y"}, {"id": 7, "l18": "ج"},
         {"id": 20, "l18": "د"}, {"id": 21, "l18": "د"}]
    b = [{"instance_code": "12", "name": "شپنا"}, {"instance_code": "3", "name": "خودرو "}, {"instance_code": "8", "name": "Y"}, {"instance_code": "9", "name": "ج"},
         {"instance_code": "", "name": "د"}, {"instance_code": "5", "name": "ه"}]
    fa, fb, ia, ib = match(spark, a, b)
    pairs = vendors.match(ia, ib)
    assert sorted((r.key, r.by_name) for r in pairs.collect()) == [("12", False), ("3", False), ("Y", True)]
    coded = vendors.match_by_code(ia, ib)
    outcomes = {r.folded: r.outcome for r in vendors.symbol_outcomes(vendors.leftovers(ia, coded, "a"), vendors.leftovers(ib, coded, "b")).collect()}
    assert outcomes == {"Y": "pair", "ج": "id_conflict", "د": "ambiguous"}
    assert [r.code for r in vendors.repeated_codes(ia).collect()] == ["5"]
    assert vendors.leftovers(ia, pairs, "a").count() == 5 and vendors.duplicate_symbols(ia).count() == 1


def test_field_stats_are_exclusive(spark):
    values = [("5", '"5"'), ("0", '"0"'), ("5", '"6"'), ("5", '"x"'), ("null", '"3"'), ("null", '""'), ("1.5", '"x"')]
    a = ["{" + f'"id": {i}, "l18": "s{i}", "tvol": {va}' + "}" for i, (va, _) in enumerate(values)]
    b = ["{" + f'"instance_code": "{i}", "name": "s{i}", "trade_volume": {vb}' + "}" for i, (_, vb) in enumerate(values)]
    fa, fb, ia, ib = match(spark, a, b)
    v = vendors.field_values(vendors.pair_rows(vendors.match(ia, ib), fa, fb))
    s = vendors.field_stats(v).filter("field = 'volume'").first()
    assert (s.both, s.match, s.nonzero_match, s.mismatch, s.only_a, s.only_b, s.neither, s.both_bad, s.bad_a, s.bad_b) == (3, 2, 1, 2, 0, 1, 1, 1, 1, 2)
    assert {r.ahead: r.n for r in vendors.volume_ahead(v).collect()} == {"equal": 1, "both_zero": 1, "b": 1, "missing": 4}


IDENTITIES = [
    ("IRO1FOLD0001", "27", "فولاد مبارکه", "فولاد", classmap.MAIN_MARKET, "stock"), ("IRO3ABCD0001", "27", "x", "x", classmap.SECOND_MARKET, "stock"),
    ("IRO7ABCD0001", "27", "x", "x", classmap.BASE_MARKET, "stock"), ("IRR1ABCD0101", "27", "ح . x", "xح", classmap.RIGHTS, "stock"),
    ("IRO1FOLD0002", "27", "x", "x", "تابلو غیرعادی (…0002)", None), ("IRE9ABCD0001", "27", "x", "x", classmap.ENERGY, None), ("IRB3ABCD0001", "69", "x", "x", classmap.BOND, "fixed_income"),
    ("IRBZABCD0001", "10", "x", "x", classmap.NO_GROUP, None), ("IRXXABCD0001", "0069", "x", "x", classmap.BOND, "fixed_income"),
    ("IRTKABCD0001", "68", "صندوق طلا", "عیار", classmap.GOLD_FUND, "gold"), ("IRTKABCD0001", "68", "صندوق نقره", "x", classmap.SILVER_FUND, "silver"),
    ("IRTKABCD0001", "68", "صندوق س. كالاي x", "نقرين", classmap.SILVER_FUND, "silver"), ("IRTKABCD0001", "68", "x", "پلاتا", classmap.OTHER_COMMODITY, None),
    ("IRT1ABCD0001", "68", "صندوق س. x-د", "x", classmap.FIXED_FUND, "fixed_income"), ("IRT1ABCD0001", "68", "صندوق درآمد ثابت x", "x", classmap.FIXED_FUND, "fixed_income"),
    ("IRT1ABCD0001", "68", "صندوق س. سهامي x", "x", classmap.EQUITY_FUND, "equity_etf"), ("IRT1ABCD0001", "68", "صندوق املاک", "x", classmap.OTHER_FUND, "other_fund"), ("", "", "", "", classmap.NO_GROUP, None)]


def test_instrument_groups(spark):
    df = spark.createDataFrame([(i, *r[:4]) for i, r in enumerate(IDENTITIES)], "i int, isin string, sector string, name string, symbol string")
    g = classmap.instrument_group(F.col("isin"), F.col("sector"), F.col("name"), F.col("symbol"))
    got = [(r.g, r.c) for r in df.withColumn("g", g).withColumn("c", classmap.group_class(F.col("g"))).orderBy("i").collect()]
    assert got == [r[4:] for r in IDENTITIES]


def book(levels: int = 5) -> dict:
    return {f"{k}{i}": i for i in range(1, levels + 1) for k in ("zd", "qd", "pd", "zo", "qo", "po")}


def test_feed_a(spark):
    base = {"l18": "x", "pl": 100, "pc": 101, "pf": 99, "py": 98, "pmin": 97, "pmax": 102, "tno": 3, "tvol": 10, "tval": 1000, "tmin": 90, "tmax": 110,
            **{f"{s}_{p}_Volume": 5 for s in ("Buy", "Sell") for p in "IN"}, **{f"{s}_Count{p}": 1 for s in ("Buy", "Sell") for p in "IN"}}
    rows = [{**base, "id": 72044846109864381, **book()}, {**base, "id": 2, "pl": 1, **book()}, {**base, "id": 3, "pl": 1, "tvol": 0, "tval": 0}, {**base, "id": "abc"},
            {**base, "id": 4, "tvol": -1, "tmin": 1, "tmax": 999_999_999, **book(4)}]
    got = {r.ins_code: r for r in vendor_feeds.ingest_a(feed(spark, rows)).collect()}
    assert sorted(got) == ["2", "3", "4", "72044846109864381"]
    assert got["72044846109864381"].missing == [] and len(got["72044846109864381"].book) == 5 and got["72044846109864381"].book[1].BidPrice == 2
    assert got["2"].missing == ["price_last", "value"] and got["2"].value is None
    assert got["3"].missing == ["price_last", "book"] and got["3"].value == 0
    assert got["4"].missing == ["volume", "price_limits", "book"] and got["4"].volume is None


def test_feed_b(spark):
    rows = [{"instance_code": "1", "name": "x", "close_price": "0", "trade_volume": "1,000", "daily_price_low": "3170.00", "daily_price_high": "3300.50"},
            {"instance_code": "2", "name": "y", "close_price": "10", "daily_price_low": "3170.00", "daily_price_high": "3300.00"}, {"name": "no code"}]
    got = {r.ins_code: r for r in vendor_feeds.ingest_b(feed(spark, rows)).collect()}
    assert sorted(got) == ["1", "2"] and got["1"].price_last is None and got["1"].volume == 1000 and got["1"].price_limit_min is None
    assert (got["2"].price_limit_min, got["2"].price_limit_max) == (3170, 3300) and got["2"].missing[-1] == "book"


@pytest.mark.parametrize("bad, reason", [
    ("null", "not a JSON object"), ("[1]", "not a JSON object"), ('{"ins_code": 12', "not a JSON object"), ("{}", "empty ins_code"), ('{"ins_code":"A"}', "missing source_time"),
    ('{"ins_code":"A","source_time":"2026-09-23T09:00:00+03:30","price_last":1,"volume":1,"value":1,"ind_buy_vol":1,"ind_sell_vol":1,"ind_buy_count":1}', "field ind_sell_count absent"),
    ('{"ins_code":"A","source_time":"2026-09-23T09:00:00+03:30","price_last":1,"volume":null,"value":1,"ind_buy_vol":1,"ind_sell_vol":1,"ind_buy_count":1,"ind_sell_count":1}', "field volume absent"),
    ('{"ins_code":"A","source_time":"2026-09-23T09:00:00+03:30","volume":"7"}', "wrong type"), ('{"ins_code":12,"source_time":"2026-09-23T09:00:00+03:30"}', "wrong type")])
def test_admission(spark, bad, reason):
    from tapeloom.sources import recordings

    good = '{"ins_code":"A","source_time":"2026-09-23T09:00:00+03:30","price_last":1,"volume":1,"value":1,"ind_buy_vol":1,"ind_sell_vol":1,"ind_buy_count":1,"missing":["ind_sell_count"]}'
    raw = spark.createDataFrame([(1, None, bad), (2, "md.snap.A", good)], "seq long, subject string, payload string")
    rows, quarantine = recordings.decode_snapshots(raw)
    kept = rows.collect()
    assert [r.seq for r in kept] == [2] and kept[0].ind_sell_count is None and kept[0].trade_count == 0
    assert quarantine.first().error.startswith(reason)


@pytest.mark.parametrize("text, good", [
    ("2026-09-23T09:00:00+03:30", True), ("2026-09-23T05:30:00Z", True), ("2026-09-23T05:30:00.123456789Z", True), ("2026-09-23 05:30:00Z", False),
    ("2026-09-23", False), ("2026-09-23T05:30:00", False), ("2026-09-23T05:30Z", False), ("2026-09-23t05:30:00z", False), ("2026-02-30T05:30:00Z", False),
    ("2026-09-23T05:30:00 Asia/Tehran", False), ("2026-9-23T05:30:00Z", False), ("2026-09-23T25:30:00Z", False), ("", False)])
def test_instants_are_rfc3339(spark, text, good):
    from tapeloom.sources import recordings

    flow = '"price_last":1,"volume":1,"value":1,"ind_buy_vol":1,"ind_sell_vol":1,"ind_buy_count":1,"ind_sell_count":1'
    raw = spark.createDataFrame([(1, None, f'{{"ins_code":"A","source_time":"{text}",{flow}}}'),
                                 (2, None, f'{{"ins_code":"A","ingest_time":"{text}","source_time":"2026-09-23T05:30:00Z",{flow}}}')], "seq long, subject string, payload string")
    rows, quarantine = recordings.decode_snapshots(raw)
    assert rows.count() == (2 if good else 0)
    assert [r.error for r in quarantine.collect()] == ([] if good else ["wrong type"] * 2)


def test_last_of_repeated_keys_and_null_data(spark):
    """As in a decoder that fills one record: the last of repeated keys counts; an envelope around null is no bare snapshot."""
    from tapeloom.sources import recordings

    flow = '"price_last":1,"volume":1,"value":1,"ind_buy_vol":1,"ind_sell_vol":1,"ind_buy_count":1,"ind_sell_count":1'
    body = f'{{"ins_code":"B","ins_code":"A","source_time":"2026-09-23T05:30:00Z",{flow},"volume":7,"other":{{"volume":"x","a":[{{}}]}}}}'
    lines = spark.createDataFrame([(5, body), (6, f'{{"seq":60,"subject":"md.snap.A","data":{body}}}'), (7, '{"subject":"md.snap.A","data":null}'), (8, "  "), (9, "{")],
                                  "seq long, value string")
    rows, quarantine = recordings.decode_snapshots(recordings.envelopes(lines))
    assert sorted((r.seq, r.ins_code, r.volume) for r in rows.collect()) == [(5, "A", 7), (60, "A", 7)]
    assert sorted((r.seq, r.error) for r in quarantine.collect()) == [(7, "not a JSON object"), (9, "not a JSON object")]
