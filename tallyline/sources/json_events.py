"""Read wire events from JSON (A1/A2) into the text-typed wire frame.

Two layouts:

* ``read_event_array``: files holding one event object or an array of them. A
  JSON document is not splittable, so one file is one task; use it for bounded
  uploads. A file that is no JSON document fails the read.
* ``read_event_lines``: JSON Lines, splittable across tasks; the scale path.

Positions are event numbers in file order (files by path), the same however
the files are split, so a replay gives the same positions.

Every field is read as text so validation sees exactly what was sent (a
numeric ``amount`` keeps its literal digits); the keys present in each object
are kept so unknown fields can be rejected (B7), and fields whose JSON value is
of the wrong type are named in ``wrong_types``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.schema import WIRE_FIELDS, WIRE_SCHEMA


def _wrong_types(value: Column) -> Column:
    """Names of the fields of a parsed event that hold another JSON type than
    text (an amount may be a number)."""
    kinds = F.array(*[F.struct(F.lit(f).alias("field"), F.schema_of_variant(F.try_variant_get(value, f"$.{f}", "variant")).alias("kind"))
                      for f in WIRE_FIELDS])

    def wrong(x: Column) -> Column:
        number = (x["field"] == "amount") & (x["kind"].isin("BIGINT", "DOUBLE") | x["kind"].startswith("DECIMAL"))
        return x["kind"].isNotNull() & ~x["kind"].isin("STRING", "VOID") & ~number

    return F.transform(F.filter(kinds, wrong), lambda x: x["field"])


def wire_from_json(rows: DataFrame, batch_id: int) -> DataFrame:
    """The wire frame of raw events (pos, raw_json). Each text is parsed once
    as a struct, once as a variant and once for its keys: the parsed columns are
    made first and then referred to, so that no field parses it again."""
    parsed = rows.select("pos", "raw_json", F.from_json("raw_json", WIRE_SCHEMA).alias("event"),
                         F.try_parse_json("raw_json").alias("variant"), F.json_object_keys("raw_json").alias("keys"))
    keys = F.coalesce("keys", F.array().cast("array<string>"))
    return parsed.select(
        F.lit(batch_id).cast("int").alias("batch_id"),
        F.col("pos").cast("long").alias("pos"),
        *[F.col("event")[f].alias(f) for f in WIRE_FIELDS],
        F.array_except(keys, F.array(*[F.lit(f) for f in WIRE_FIELDS])).alias("extra_keys"),
        _wrong_types(F.col("variant")).alias("wrong_types"),
        "raw_json",
    )


def read_event_array(spark: SparkSession, path: str, batch_id: int = 0) -> DataFrame:
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
    return wire_from_json(numbered_events(text), batch_id)


def numbered_events(text: DataFrame) -> DataFrame:
    """(pos, raw_json) of the events of whole documents (value, file)."""
    body = F.trim(F.col("value"))
    events = F.when(body.startswith("["), F.from_json(body, "array<string>")).when(
        F.json_object_keys(body).isNotNull(), F.array(body))
    documents = text.select("file", F.coalesce(events, F.raise_error(F.concat(
        F.lit("not a JSON document: "), F.col("file"))).cast("array<string>")).alias("events"))
    # One row per file: where its events start.
    earlier = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    starts = documents.groupBy("file").agg(F.sum(F.size("events")).alias("n")).select(
        "file", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return (documents.select("file", F.posexplode("events").alias("nth", "raw_json")).join(starts, "file")
            .select((F.col("start") + F.col("nth")).alias("pos"), "raw_json"))


def numbered_lines(lines: DataFrame) -> DataFrame:
    """(pos, raw_json) of text lines (value, file, block): the number of each
    non-blank line in file order.

    Lines of one split have consecutive ids; the splits' counts (one row per
    split) give each split its first number.
    """
    rows = lines.filter(F.trim("value") != "").select("value", "file", "block", F.monotonically_increasing_id().alias("id"))
    earlier = Window.orderBy("file", "block").rowsBetween(Window.unboundedPreceding, -1)
    splits = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).select(
        "file", "block", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("start"))
    return rows.join(splits, ["file", "block"]).select(
        (F.col("start") + F.col("id") - F.col("first")).alias("pos"), F.col("value").alias("raw_json"))


def text_lines(reader) -> DataFrame:
    """Lines with the file and split they come from."""
    return reader.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def read_event_lines(spark: SparkSession, path: str, batch_id: int = 0) -> DataFrame:
    """JSON Lines, numbered across all files."""
    return wire_from_json(numbered_lines(text_lines(spark.read.text(path))), batch_id)


def event_to_json(df: DataFrame) -> DataFrame:
    """Serialise typed deliveries back to the wire format (one JSON per row)."""
    return df.select(F.to_json(F.struct(
        F.col("event_id").cast("string").alias("event_id"), "event_type",
        F.col("transaction_id").cast("string").alias("transaction_id"),
        F.col("merchant_id").cast("string").alias("merchant_id"), "merchant_name",
        F.col("amount").cast("string").alias("amount"), "currency",
        F.date_format("occurred_at", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("timestamp"),
    )).alias("value"))
