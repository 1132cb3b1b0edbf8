"""Recorded snapshot streams (NDJSON) and the admission contract of a snapshot message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tapeloom.functions.rules import all_of, any_of
from tapeloom.operators.quality import UNDECODABLE
from tapeloom.runtime import prepare
from tapeloom.schemas import COUNTS, FLOW_FIELDS, LIMITS, PRICES, SNAPSHOT_JSON

SUBJECT = "md.snap."


def envelopes(lines: DataFrame) -> DataFrame:
    """(seq, value) -> (seq, subject, payload, message): envelopes and bare snapshots alike; blank lines are skipped.

    ``message`` is the payload as a variant (NULL where the line is no JSON), ``payload`` its text for whoever looks at rejected ones.
    Without a number from the caller, ``seq`` is the recorded one. A line is parsed once.
    """
    prepare(lines.sparkSession)
    parsed = lines.filter(F.trim("value") != "").withColumn("line", F.try_parse_json("value"))
    data = F.try_variant_get("line", "$.data", "variant")
    recorded = F.try_variant_get("line", "$.seq", "bigint")
    rows = parsed.select(F.coalesce(recorded, F.col("seq")).alias("seq"), F.try_variant_get("line", "$.subject", "string").alias("subject"),
                         F.when(data.isNull(), F.col("value")).otherwise(F.to_json(data)).alias("payload"), F.coalesce(data, F.col("line")).alias("message"))
    return rows


def read_recording(spark: SparkSession, path: str) -> DataFrame:
    """Recorded lines with their arrival order.

    ``seq`` is taken from the recording where it carries one (a bus offset). Otherwise files follow each
    other by name, and a line's place in its file is the byte offset of its split plus its row in it.
    """
    lines = spark.read.text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("nth"))
    # The names alone, written as the lines have them; no content is read.
    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_path").alias("file"))
    files = files.withColumn("file_no", F.row_number().over(W.orderBy("file")).cast("bigint") - 1)
    placed = lines.join(files, "file", "left")
    file_no = F.coalesce("file_no", F.raise_error(F.concat(F.lit("no place for recording file "), F.col("file"))).cast("bigint"))
    derived = F.shiftleft(file_no, 40) + F.col("block") + F.col("nth")
    return envelopes(placed.select(derived.alias("seq"), "value"))


def stream_recording(spark: SparkSession, path: str) -> DataFrame:
    """The same lines as a stream; their ``seq`` must be in the recording."""
    lines = spark.readStream.text(path)
    return envelopes(lines.select(F.lit(None).cast("bigint").alias("seq"), "value"))


# An instant as RFC 3339 writes it: capital T and Z, seconds, a zone; no space, no date alone, no zone name.
RFC3339 = r"^[0-9]{4}-[0-9]{2}-[0-9]{2}T[0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?(Z|[+-][0-9]{2}:[0-9]{2})$"
INSTANTS = ["source_time", "ingest_time"]


def _typed() -> Column:
    """Every field present in the message has its JSON type; an absent or null field has none.

    Needs ``kinds``: field name -> type of its JSON value.
    """
    def all_in(names: list[str], kind: str) -> Column:
        return F.forall(F.array(*[F.lit(n) for n in names]), lambda n: F.coalesce(F.try_element_at("kinds", n), F.lit("VOID")).isin("VOID", kind))

    book, missing = (F.coalesce(F.try_element_at("kinds", F.lit(n)), F.lit("VOID")) for n in ("book", "missing"))
    return all_of([
        all_in(["ins_code", "symbol", "source", *INSTANTS], "STRING"), all_in([*PRICES, *LIMITS, *COUNTS], "BIGINT"),
        all_in(["source_time_estimated"], "BOOLEAN"), missing.isin("VOID", "ARRAY<VOID>", "ARRAY<STRING>"),
        book.rlike(r"^(VOID|ARRAY<(VOID|OBJECT<([A-Za-z]+: (BIGINT|VOID)(, )?)*>)>)$")])


def _field(name: str, kind: str) -> Column:
    """A field of the message; an instant only where its text is RFC 3339."""
    path = f"$.{name}"
    if name in INSTANTS:
        text = F.try_variant_get("message", path, "string")
        return F.when(text.rlike(RFC3339), text.try_cast("timestamp"))
    return F.try_variant_get("message", path, kind)


def checked(raw: DataFrame) -> DataFrame:
    """Add ``s`` (the parsed snapshot) and ``error``: why the message is not a valid snapshot, else NULL.

    ``raw`` holds (seq, subject, payload), or also the ``message`` that ``envelopes`` has parsed.
    """
    prepare(raw.sparkSession)
    rows = raw if "message" in raw.columns else raw.withColumn("message", F.try_parse_json("payload"))
    fields = F.try_variant_get("message", "$", "map<string,variant>")
    parsed = F.struct(*[_field(f.name, f.dataType.simpleString()).alias(f.name) for f in SNAPSHOT_JSON.fields])
    rows = rows.withColumn("kinds", F.transform_values(fields, lambda k, x: F.schema_of_variant(x))).withColumn("s", parsed)
    listed = F.coalesce(F.col("s.missing"), F.array())
    unlisted = [F.when(F.col(f"s.{f}").isNull() & ~F.array_contains(listed, f), F.lit(f)) for f in FLOW_FIELDS]
    unreadable = any_of([(F.coalesce(F.try_element_at("kinds", F.lit(t)), F.lit("VOID")) != "VOID") & F.col(f"s.{t}").isNull() for t in INSTANTS])
    elsewhere = F.coalesce(F.col("subject") != F.concat(F.lit(SUBJECT), F.col("s.ins_code")), F.lit(False))
    error = (F.when(F.col("kinds").isNull(), "not a JSON object").when(~F.coalesce(_typed(), F.lit(False)) | unreadable, "wrong type")
             .when(F.coalesce(F.col("s.ins_code"), F.lit("")) == "", "empty ins_code").when(F.col("s.source_time").isNull(), "missing source_time")
             .when(F.coalesce(*unlisted).isNotNull(), F.concat(F.lit("field "), F.coalesce(*unlisted), F.lit(" absent but not listed in missing")))
             .when(elsewhere, "ins_code differs from the subject"))
    # a one-element explode: filters on the error stay above it, so the message is parsed once
    return rows.select("*", F.explode(F.array(error)).alias("error")).drop("message", "kinds")


def canonical(rows: DataFrame, snapshot: str = "s") -> DataFrame:
    """Columns of the canonical table: listed fields are NULL, other absent numbers are 0, absent limits are NULL."""
    listed = F.coalesce(F.col(f"{snapshot}.missing"), F.array().cast("array<string>"))
    out = {}
    for name in (*PRICES, *COUNTS):
        out[name] = F.when(~F.array_contains(listed, name), F.coalesce(F.col(f"{snapshot}.{name}"), F.lit(0).cast("bigint")))
    for name in LIMITS:
        limit = F.col(f"{snapshot}.{name}")
        out[name] = F.when(~F.array_contains(listed, "price_limits") & (limit != 0), limit)
    fields = [f.name for f in SNAPSHOT_JSON.fields]
    out["source_time_estimated"] = F.coalesce(F.col(f"{snapshot}.source_time_estimated"), F.lit(False))
    out["missing"] = listed
    return rows.select("seq", *[out[n].alias(n) if n in out else F.col(f"{snapshot}.{n}").alias(n) for n in fields])


def decode_snapshots(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(seq, subject, payload) -> (canonical snapshots, quarantined messages)."""
    rows = checked(raw)
    good = canonical(rows.filter(F.col("error").isNull()))
    return good, rows.filter(F.col("error").isNotNull()).drop("s")


def undecodable_issues(quarantine: DataFrame, stored_at: Column) -> DataFrame:
    """Quarantined messages as quality issues at their store time."""
    code = F.coalesce(F.when(F.col("subject").startswith(SUBJECT), F.substring("subject", len(SUBJECT) + 1, 1000)), F.lit(""))
    return quarantine.select("seq", code.alias("ins_code"), F.lit(UNDECODABLE).alias("code"), F.col("error").alias("detail"), stored_at.alias("at"))
