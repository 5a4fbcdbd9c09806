"""Turns an event table into session recordings.

About 50 users make a subject, stretches of three days a session, and a session's time axis is scaled to
360 seconds. With more users there are more subjects, not longer sessions, so no group of the analysis grows with the table. Values are amplitudes, and 600 + 4 * value is an interval between beats in milliseconds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SESSION_MICROS = 259_200_000_000
MICROS_PER_SECOND = 720_000_000
DURATION = 360.0


def subject_count(events: DataFrame, least: int = 10, users_each: int = 50) -> int:
    """How many subjects the users make up."""
    return max(least, events.agg(F.countDistinct("user_id")).first()[0] // users_each)


def samples_from_events(events: DataFrame, subjects: int | None = None) -> DataFrame:
    """``Subject, Session, ConditionCode, t, x, rr``; odd sessions are A, even ones NA."""
    subjects = subjects or subject_count(events)
    since = F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    session = (F.floor(since / SESSION_MICROS) + 1).cast("int")
    return events.filter("ts is not null and value is not null").select(
        F.format_string("P%02d", (F.col("user_id") % subjects).cast("int")).alias("Subject"),
        session.alias("Session"),
        F.when(session % 2 == 1, "A").otherwise("NA").alias("ConditionCode"),
        (F.pmod(since, F.lit(SESSION_MICROS)) / F.lit(float(MICROS_PER_SECOND))).alias("t"),
        F.col("value").alias("x"),
        (600 + 4 * F.col("value")).alias("rr"),
    )
