"""O12 alert_gate, O13 build_notifications, O16 filter_events, O17 attach_email."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Webhook type acted on, alert title, channel payload format.
# ---------------------------------------------------------------------------
RECEIVED_TYPE = "email.received"
ALERT_TITLE = "New estimate request received"
EMBED_TITLE = "Details"
FIELD_VALUE_LIMIT = 1024
EMPTY_FIELD_VALUE = "N/A"
MISSING_EMAIL_MESSAGE = "The mail service did not return email data"
LOOKUP_FAILED_PREFIX = "Error fetching email: "
UNSUPPORTED_CHANNEL_PREFIX = "Unsupported notification channel: "
# ---------------------------------------------------------------------------
CONFLICT_MESSAGE = "Several different mails have this id"


def filter_events(deliveries: DataFrame, type_col: str = "type") -> tuple[DataFrame, DataFrame]:
    """(deliveries of type ``email.received``, all others)."""
    is_received = F.col(type_col).eqNullSafe(F.lit(RECEIVED_TYPE))
    return deliveries.filter(is_received), deliveries.filter(~is_received)


def one_mail(emails: DataFrame, key: str = "email_id", version: str | None = None) -> DataFrame:
    """One row per id (the mail service gives exactly one mail for an id).

    Equal rows are one mail.  Of several versions the latest counts
    (``version``: a column that sorts; a NULL is the oldest).  Rows of one
    version that differ are a conflict: the row has a ``lookup_error``.  The
    choice does not depend on the order of the rows, and copies are combined
    before they are shuffled.  A NULL id names no mail."""
    held = [c for c in emails.columns if c != key]
    rank = F.col(version) if version else F.lit(0)
    rows = emails.where(F.col(key).isNotNull()).select(
        key, F.struct(*held).alias("_mail"), rank.alias("_rank"), F.xxhash64(*held).alias("_hash"))
    top = F.struct("_rank", "_hash")
    # equal contents have equal hashes: the least and the greatest of the latest version tell a conflict
    one = rows.groupBy(key).agg(
        F.max_by("_mail", top).alias("_mail"), F.max(top).alias("_top"),
        F.max(F.struct("_rank", F.bitwise_not("_hash").alias("_hash"))).alias("_low"))
    conflict = F.col("_top._hash") != F.bitwise_not(F.col("_low._hash"))
    error = F.col("_mail.lookup_error") if "lookup_error" in held else F.lit(None).cast("string")
    return one.select(key, *[F.col(f"_mail.{c}").alias(c) for c in held if c != "lookup_error"],
                      F.when(conflict, F.lit(CONFLICT_MESSAGE)).otherwise(error).alias("lookup_error"))


def lookup_email(deliveries: DataFrame, emails: DataFrame, key: str = "email_id",
                 version: str | None = None) -> DataFrame:
    """O17 as one left join: the deliveries with their mail's columns and
    ``error_message`` (NULL when found); every delivery stays one row, see
    :func:`one_mail`.  A mail row with a ``lookup_error`` is a failed lookup,
    another cause than a missing mail."""
    wanted = deliveries.select(key).distinct()  # ids first: text that nobody asks for is not moved
    mails = one_mail(emails.join(wanted, key, "left_semi"), key, version)
    joined = deliveries.join(mails.withColumn("_found", F.lit(True)), key, "left")
    failed = F.col("lookup_error")
    cause = (F.when(failed == CONFLICT_MESSAGE, failed)
             .when(failed.isNotNull(), F.concat(F.lit(LOOKUP_FAILED_PREFIX), failed))
             .when(F.col("_found").isNull(), F.lit(MISSING_EMAIL_MESSAGE)))
    return joined.withColumn("error_message", cause).drop("_found", "lookup_error")


def attach_email(deliveries: DataFrame, emails: DataFrame, key: str = "email_id",
                 version: str | None = None) -> tuple[DataFrame, DataFrame]:
    """O17 split: (deliveries joined with their mail, deliveries whose mail is
    missing, could not be fetched or is ambiguous, with ``error_message``)."""
    joined = lookup_email(deliveries, emails, key, version)
    return (joined.filter(F.col("error_message").isNull()).drop("error_message"),
            joined.filter(F.col("error_message").isNotNull()).select(*deliveries.columns, "error_message"))


def alert_gate(results: DataFrame, flag: str = "should_alert_admin") -> tuple[DataFrame, DataFrame]:
    """(rows whose flag is exactly true, all others - NULL included)."""
    is_alert = F.col(flag).eqNullSafe(F.lit(True))
    return results.filter(is_alert), results.filter(~is_alert)


def _field_value(value: Column) -> Column:
    """Strings as they are, cut to 1024 characters; empty -> 'N/A'.

    The cut counts code points; JavaScript counts UTF-16 units, which only
    differs for characters outside the Basic Multilingual Plane.
    """
    cut = F.substring(F.coalesce(value.cast("string"), F.lit("")), 1, FIELD_VALUE_LIMIT)
    return F.when(cut == "", F.lit(EMPTY_FIELD_VALUE)).otherwise(cut)


def discord_body(title: Column, message: Column | None, fields: list[tuple[str, Column]],
                 timestamp: Column) -> Column:
    """The Discord webhook body as a JSON string."""
    content = (F.concat(F.lit("**"), title, F.lit("**")) if message is None else
               F.when(message.isNotNull() & (message != ""),
                      F.concat(F.lit("**"), title, F.lit("**\n"), message))
               .otherwise(F.concat(F.lit("**"), title, F.lit("**"))))
    field_structs = [F.struct(F.lit(name).alias("name"), _field_value(v).alias("value"),
                              F.lit(False).alias("inline")) for name, v in fields]
    embeds = (F.array(F.struct(F.lit(EMBED_TITLE).alias("title"), F.array(*field_structs).alias("fields"),
                               timestamp.alias("timestamp")))
              if field_structs else F.lit(None))
    return F.to_json(F.struct(content.alias("content"), embeds.alias("embeds")))


CHANNELS: dict[str, Callable[..., Column]] = {"discord": discord_body}


def _channel(channel: str | Column) -> Column:
    return F.lit(channel) if isinstance(channel, str) else channel


def channel_error(channel: str | Column) -> Column:
    """Why a notification cannot be sent through a row's channel, or NULL."""
    name = _channel(channel).cast("string")
    return F.when(~F.coalesce(name.isin(*CHANNELS), F.lit(False)),
                  F.concat(F.lit(UNSUPPORTED_CHANNEL_PREFIX), F.coalesce(name, F.lit("null"))))


def route_notifications(alerts: DataFrame, emails: DataFrame | None = None, channel: str | Column = "discord",
                        timestamp: str = "1970-01-01T00:00:00.000Z",
                        key: str = "email_id") -> tuple[DataFrame, DataFrame]:
    """(one notification body per alert, alerts that cannot be sent).

    ``channel`` is a name or a column of the alerts: every row goes through
    its own channel of the registry ``CHANNELS``.  An unknown or NULL channel
    is an error of that row, with ``error_message``.

    Fields come from the *raw* mail (sender, original subject) and the
    result (service label, explanation).  ``timestamp`` is a parameter so
    the output is deterministic.  Without ``emails`` the alerts carry the raw
    mail themselves (``from``, ``raw_subject``).  ``delivery_id`` and
    ``received_at`` stay on the rows when the alerts have them.
    """
    claim = [c for c in ("delivery_id", "received_at") if c in alerts.columns]
    routed = alerts.withColumns({"_channel": _channel(channel).cast("string"), "_error": channel_error(channel)})
    failed = routed.where(F.col("_error").isNotNull()).select(key, *claim, F.col("_error").alias("error_message"))
    good = routed.where(F.col("_error").isNull())
    if emails is None:
        joined = good.withColumns({"_from": F.col("from"), "_raw_subject": F.col("raw_subject")})
    else:
        raw = one_mail(emails.select(key, F.col("from").alias("_from"), F.col("subject").alias("_raw_subject")), key)
        joined = good.join(raw.drop("lookup_error"), key, "inner")
    fields = [("customerEmail", F.col("_from")), ("emailSubject", F.col("_raw_subject")),
              ("serviceType", F.col("service_type_label")), ("summary", F.col("explanation"))]
    body = F.lit(None).cast("string")
    for name, render in CHANNELS.items():
        body = F.when(F.col("_channel") == name, render(F.lit(ALERT_TITLE), None, fields, F.lit(timestamp))).otherwise(body)
    return joined.select(key, *claim, F.col("_channel").alias("channel"), F.lit(ALERT_TITLE).alias("title"),
                         body.alias("body_json")), failed


def build_notifications(alerts: DataFrame, emails: DataFrame | None = None, channel: str | Column = "discord",
                        timestamp: str = "1970-01-01T00:00:00.000Z", key: str = "email_id") -> DataFrame:
    """The notifications of :func:`route_notifications` alone."""
    return route_notifications(alerts, emails, channel, timestamp, key)[0]
