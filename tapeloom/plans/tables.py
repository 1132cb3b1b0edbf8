"""Registered queries that go through a stored form and back: recordings, stored tables, envelopes and CSV."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom import sinks
from tapeloom.operators import flow, market
from tapeloom.plans import market as market_plans
from tapeloom.plans import tape, tape_sql
from tapeloom.plans.market import Market
from tapeloom.plans.registry import Registry
from tapeloom.runtime import shared_dir
from tapeloom.schemas import SNAPSHOT_JSON
from tapeloom.sources import recordings


def _path(t: Market, name: str) -> str:
    return f"{shared_dir(t.spark)}/{name}-{uuid.uuid4().hex}"


def recorded(t: Market) -> DataFrame:
    """The tape as recorded lines: envelopes, every third one bare, and damaged at fixed positions."""
    fields = [f.name for f in SNAPSHOT_JSON.fields if f.name in t.snapshots.columns]
    seq = F.col("seq")
    damaged = F.when(seq % 71 == 0, "").otherwise(F.col("ins_code"))
    body = F.to_json(F.struct("seq", damaged.alias("ins_code"), *[c for c in fields if c != "ins_code"]))
    body = F.when(seq % 73 == 0, F.regexp_replace(body, r'"volume":(-?\d+)', '"volume":"$1"')).otherwise(body)
    envelope = F.concat(F.lit('{"seq":'), seq.cast("string"), F.lit(',"subject":"md.snap.'), "ins_code", F.lit('","data":'), body, F.lit("}"))
    line = F.when(seq % 79 == 0, F.substring(envelope, 1, 40)).when(seq % 3 == 0, body).otherwise(envelope)
    path = _path(t, "recording")
    t.snapshots.select(line.alias("value")).write.text(path)
    return recordings.read_recording(t.spark, path)


def stored(t: Market, df: DataFrame, write: Callable[[DataFrame, str], None], read: Callable[[SparkSession, str], DataFrame] | None = None,
           older: DataFrame | None = None) -> DataFrame:
    """``df`` written and read back. With a merging ``read`` it is written a second time, as a restarted run delivers it again, and
    between the two, ``older`` versions of some rows arrive: they must not win over what is stored."""
    path = _path(t, "stored")
    write(df, path)
    if read is None:
        return t.spark.read.parquet(path)
    if older is not None:
        write(older, path)
    write(df, path)
    return read(t.spark, path)


def _before(df: DataFrame, column: str, changed: dict[str, Column]) -> DataFrame:
    """Every third row as an earlier version with other values."""
    out = df.filter(F.col("seq") % 3 == 0).withColumn(column, F.col(column) - F.expr("INTERVAL 1 SECOND"))
    return out.withColumns(changed)


def register(r: Registry) -> None:
    def add(name: str, build: Callable[[Market], DataFrame], parts: list[str] | None = None, select: str | None = None) -> None:
        r.add(name, lambda spark, sf_dir: build(Market(spark, sf_dir)), tape_sql.with_(parts, select) if select else None)

    cols = ["seq", "ins_code", "symbol", "source", "source_time", "ingest_time", "source_time_estimated", "price_last", "trade_count", "volume", "value",
            "price_limit_min", "ind_buy_vol", "inst_sell_vol", "ind_buy_count"]
    add("decoded_recording", lambda t: recordings.decode_snapshots(recorded(t))[0].select(*cols), tape_sql.SNAP_BASE,
        f"SELECT {', '.join(cols)} FROM snaps WHERE seq % 71 <> 0 AND (seq % 73 <> 0 OR volume IS NULL) AND seq % 79 <> 0")

    def undecodable(t: Market) -> DataFrame:
        bad = recordings.decode_snapshots(recorded(t))[1].filter(F.col("seq").isNotNull())
        issues = recordings.undecodable_issues(bad, F.timestamp_seconds(1_704_067_200 + F.col("seq")))
        # what is no JSON has no recorded number: its place in the file counts, and with it the time here
        known = F.col("detail") != "not a JSON object"
        return issues.withColumns({"seq": F.when(known, F.col("seq")), "at": F.when(known, F.col("at"))})

    add("undecodable_issues", undecodable, tape_sql.SNAP_BASE, """SELECT CASE WHEN seq % 79 <> 0 THEN seq END AS seq,
  CASE WHEN seq % 79 = 0 OR seq % 3 = 0 THEN '' ELSE ins_code END AS ins_code, 'UNDECODABLE' AS code,
  CASE WHEN seq % 79 = 0 THEN 'not a JSON object' WHEN seq % 73 = 0 AND volume IS NOT NULL THEN 'wrong type' ELSE 'empty ins_code' END AS detail,
  CASE WHEN seq % 79 <> 0 THEN make_timestamp((1704067200 + seq) * 1000000) END AS "at"
FROM snaps WHERE seq % 71 = 0 OR seq % 79 = 0 OR (seq % 73 = 0 AND volume IS NOT NULL)""")
    add("undecodable_by_reason", lambda t: undecodable(t).groupBy("code", "detail").agg(F.count(F.lit(1)).alias("n")), tape_sql.SNAP_BASE,
        """SELECT 'UNDECODABLE' AS code, CASE WHEN seq % 79 = 0 AND seq % 3 <> 0 THEN 'not a JSON object' WHEN seq % 79 = 0 THEN 'not a JSON object'
  WHEN seq % 73 = 0 THEN 'wrong type' ELSE 'empty ins_code' END AS detail, count(*) AS n FROM snaps WHERE seq % 71 = 0 OR seq % 73 = 0 OR seq % 79 = 0 GROUP BY ALL""")

    kept = ["seq", "ins_code", "source", "source_time", "ingest_time", "volume"]
    add("stored_snapshots", lambda t: stored(t, t.snapshots, sinks.write_snapshots, sinks.read_snapshots,
                                              _before(t.snapshots, "ingest_time", {"volume": F.lit(-1).cast("bigint")})).select(*kept, "day"), tape_sql.SNAP_BASE,
        f"""SELECT {', '.join(kept)}, CAST(source_time AS DATE) AS day FROM snaps
QUALIFY row_number() OVER (PARTITION BY ins_code, source_time, source ORDER BY ingest_time DESC, seq DESC) = 1""")

    def events(t: Market) -> DataFrame:
        return flow.flow_events(flow.attribute(flow.side_flows(t.accepted), t.p), t.p)

    add("stored_flow_events", lambda t: stored(t, events(t).drop("day"), sinks.write_flow_events).select("seq", "ins_code", "side", "value", "day"), tape_sql.FLOW,
        f"""SELECT seq, ins_code, side, value, CAST(interval_to AS DATE) AS day FROM sides WHERE band IN ('hot', 'hot_plus') OR (band IS NULL AND value >= {tape_sql.P['hot']})""")
    windows = ["ins_code", "class", "window_start", "net_hot", "price_open", "price_last", "partial"]

    def window_states(t: Market) -> DataFrame:
        """Every published state of the windows, as a sink receives them."""
        at = t.accepted.select("seq", F.col("source_time").alias("updated_at"))
        return flow.running_10m(t.accepted, t.p).join(at, "seq").drop("day")

    add("stored_windows", lambda t: stored(t, window_states(t), sinks.write_flow_10m, sinks.read_flow_10m,
                                            _before(window_states(t), "updated_at", {"net_hot": F.lit(-1).cast("bigint"), "partial": F.lit(None).cast("boolean")})).select(*windows), [*tape_sql.FLOW, tape_sql.WINDOWS],
        f"SELECT {', '.join(windows)} FROM tenrun QUALIFY row_number() OVER (PARTITION BY ins_code, window_start ORDER BY updated_at DESC, seq DESC) = 1")

    def twice(t: Market) -> DataFrame:
        """Issues of a run, delivered again by a restarted one."""
        return stored(t, t.issues, sinks.write_quality, sinks.read_quality).groupBy("code").agg(F.count(F.lit(1)).alias("n"))

    add("stored_issues", twice, [*tape_sql.ENGINE, tape.ISSUES], "SELECT code, CASE WHEN code = 'DAY_START_MISSED' THEN 1 ELSE 2 END * count(*) AS n FROM issues GROUP BY code")

    def subjects(t: Market) -> DataFrame:
        outputs = {"snapshots": t.snapshots, "events": events(t), "day_totals": flow.day_totals(t.accepted, t.p), "windows": flow.ten_minutes(t.accepted, t.p),
                   "issues": t.issues}
        every = None
        for kind, df in outputs.items():
            e = sinks.envelopes(df, kind)
            every = e if every is None else every.unionByName(e)
        return every.groupBy("subject").agg(F.count(F.lit(1)).alias("n"))

    add("outgoing_subjects", subjects, [*tape_sql.FLOW, tape_sql.GAMES, tape_sql.WINDOWS, tape.ISSUES], f"""SELECT subject, count(*) AS n FROM (
  SELECT 'md.snap.' || ins_code AS subject FROM snaps UNION ALL SELECT 'flow.game.' || ins_code FROM games UNION ALL SELECT 'flow.10m.' || ins_code FROM ten
  UNION ALL SELECT 'quality.' || ins_code FROM issues
  UNION ALL SELECT 'flow.event.' || ins_code FROM sides WHERE band IN ('hot', 'hot_plus') OR (band IS NULL AND value >= {tape_sql.P['hot']})) GROUP BY subject""")

    def messages(t: Market) -> DataFrame:
        """What the subjects carry: outputs written as messages, read back as a subscriber reads them."""
        kinds = {"day_totals": (flow.running_day_totals(t.accepted, t.p), "net_hot", "volume"), "windows": (flow.running_10m(t.accepted, t.p), "net_hot", "price_last"),
                 "events": (events(t), "value", "participants"), "issues": (t.issues, "seq", "seq"), "signals": (t.signals, "seq", "seq")}
        path, out = _path(t, "messages"), None
        for kind, (df, *_) in kinds.items():
            sinks.write_envelopes(df, kind, f"{path}/{kind}")
        for kind, (_, first, second) in kinds.items():
            lines = t.spark.read.text(f"{path}/{kind}").select(F.lit(None).cast("bigint").alias("seq"), "value")
            field = lambda name, type_="bigint": F.variant_get("message", f"$.{name}", type_)
            texts = F.concat_ws("/", field("code", "string"), field("kind", "string"), field("detail", "string"), field("reason", "string"))
            rows = recordings.envelopes(lines).select("subject", field("seq").alias("seq"), field(first).alias("first"), field(second).alias("second"), texts.alias("texts"))
            out = rows if out is None else out.unionByName(rows)
        return out

    add("outgoing_messages", messages, [*tape_sql.FLOW, tape_sql.GAMES, tape_sql.WINDOWS, tape.ISSUES, tape.divergence_sql(), tape.radar_sql()], f"""SELECT subject, seq, first, second, texts FROM (
  SELECT 'flow.game.' || ins_code AS subject, seq, net_hot AS first, volume AS second, '' AS texts FROM gamerun
  UNION ALL SELECT 'flow.10m.' || ins_code, seq, net_hot, price_last, '' FROM tenrun
  UNION ALL SELECT 'flow.event.' || ins_code, seq, value, participants, '' FROM sides WHERE band IN ('hot', 'hot_plus') OR (band IS NULL AND value >= {tape_sql.P['hot']})
  UNION ALL SELECT 'quality.' || ins_code, seq, seq, seq, code || '/' || detail FROM issues
  UNION ALL SELECT 'ai.signal.' || ins_code, seq, seq, seq, kind || '/' || reason FROM divergences
  UNION ALL SELECT 'ai.signal.' || ins_code, seq, seq, seq, 'anomaly/' || CASE {tape.reason_chain()} END FROM (
    SELECT *, (value - mean) / sqrt(var) AS z FROM scores WHERE scored AND i > {tape_sql.P['warm_up']} AND var > 0) WHERE abs(z) >= 4.0)""")

    def symbols_csv(t: Market) -> DataFrame:
        """The exported symbols table of every day, read back."""
        rows = t.market_rows.withColumn("now", F.max("ing").over(W.partitionBy("day")))
        path = _path(t, "symbols")
        sinks.export_symbols(market.row_status(rows, t.calendar, t.p), path)
        back = t.spark.read.csv(path, header=True)
        return back.select(*[F.col(f"`{label}`").alias(c) for c, label in sinks.CSV_HEADER.items() if c in ("ins", "last", "value", "net_hot", "src")])

    add("symbols_csv", symbols_csv, market_plans.TABLE, """SELECT ins, CAST(last AS VARCHAR) AS last, CAST(value AS VARCHAR) AS value,
  CAST(net_hot AS VARCHAR) AS net_hot, strftime(src, '%Y-%m-%dT%H:%M:%SZ') AS src FROM mmarket""")
