"""Topic messages: decoding push envelopes, routing, publishing. Works on batch and streaming frames."""

from pyspark.sql import Column, DataFrame, functions as F

from caretide.functions import variants as V


def decode_message(df: DataFrame, data: str = "data", require: str = "present") -> DataFrame:
    """Adds ``body`` (JSON text), ``doc`` (VARIANT) and ``reject_reason`` (NULL when usable).

    ``require='present'`` wants the ``encounter_id`` key; ``'truthy'`` also refuses null and ''. The two columns come
    out of a one-element ``inline``: filters on them stay above it, where otherwise every filter pushed
    towards the scan would decode and parse the message again.
    """
    df = df.withColumn("body", F.try_validate_utf8(F.try_to_binary(F.col(data), F.lit("base64")).cast("string")))
    df = df.withColumn("__doc", V.parse_object(F.col("body")))
    doc = F.col("__doc")
    usable = V.present(doc, "encounter_id")
    if require == "truthy":
        usable = F.coalesce(V.get(doc, "encounter_id", "string") != "", F.lit(False))
    reason = F.when(doc.isNull(), "invalid_payload").when(~usable, "missing_encounter_id")
    return df.select("*", F.inline(F.array(F.struct(doc.alias("doc"), reason.alias("reject_reason"))))).drop("__doc")


def flatten_envelope(df: DataFrame) -> DataFrame:
    return df.select("message.data", "message.message_id", "message.publish_time", "subscription")


def decode_envelope(df: DataFrame, data: str = "data", require: str = "present") -> tuple[DataFrame, DataFrame]:
    """(usable messages, rejects with reason)."""
    decoded = decode_message(df, data, require)
    return (
        decoded.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
        decoded.filter(F.col("reject_reason").isNotNull()).drop("doc"),
    )


def is_feedback(doc: Column) -> Column:
    return V.get(doc, "event_type", "string").eqNullSafe("classifier_feedback")


def route(doc: Column) -> Column:
    """Where a usable message goes: everything that is not feedback, including events without a type, is audit."""
    return F.when(is_feedback(doc), F.lit("feedback")).otherwise(F.lit("audit"))


def route_events(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(audit, feedback): everything that is not feedback, including events without a type, is audit."""
    return df.filter(~is_feedback(F.col("doc"))), df.filter(is_feedback(F.col("doc")))


def publish_frame(df: DataFrame, key: str | None = None) -> DataFrame:
    """Rows as ``key``/``value`` messages of JSON, nulls kept so that absent and null stay apart."""
    value = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")
    return df.select(F.col(key).cast("string").alias("key"), value) if key else df.select(value)


def publish(df: DataFrame, fmt: str, options: dict[str, str], key: str | None = None, mode: str = "append") -> None:
    """Write messages to a topic (``kafka``) or a file sink (``text``)."""
    frame = publish_frame(df, key)
    if fmt == "text":
        frame = frame.select("value")
    frame.write.format(fmt).options(**options).mode(mode).save()


def dlq_inspect(df: DataFrame, data: str = "data") -> DataFrame:
    """Dead letters with the identifiers an investigation records."""
    d = decode_message(df, data)
    doc = F.col("doc")
    return d.select(
        "message_id",
        "publish_time",
        V.get(doc, "encounter_id", "string").alias("encounter_id"),
        V.get(doc, "patient_id", "string").alias("patient_id"),
        V.get(doc, "timestamp", "string").alias("event_timestamp"),
        "reject_reason",
    )
