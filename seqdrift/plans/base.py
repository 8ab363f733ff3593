"""The token corpus that the registered queries run on, derived from the ``events`` table.

A user's events are a sequence, ordered by (ts, event_id). Time is ticks since the user's first event, duration the
event's value, pitch and instrument come from its id and type. Every 97th event is a separator, every 17th a rest and
every 11th an anticipated control. ``BASE_SQL`` says the same in SQL: relation ``ev`` (one row an event, raw tokens) and
``seqs`` (one row a sequence, token list with a leading AR).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from seqdrift import vocab as V
from seqdrift.operators.events import to_sequences

INSTRUMENTS = {"click": 0, "error": 128, "purchase": 1, "signup": 5, "view": 40}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq_id, event_id, ev_idx, t, d, pitch, instr): untokenised notes."""
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    us = F.unix_micros(F.col("ts").cast("timestamp"))
    instr = F.lit(0)
    for name, number in INSTRUMENTS.items():
        instr = F.when(F.col("event_type") == name, number).otherwise(instr)
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("seq_id"),
        "event_id",
        (F.row_number().over(order) - 1).alias("ev_idx"),
        F.least(F.floor((us - F.min(us).over(Window.partitionBy("user_id"))) / 260_000_000), F.lit(9999)).cast("int").alias("t"),
        F.least(F.floor("value"), F.lit(999)).cast("int").alias("d"),
        (F.col("event_id") % 128).cast("int").alias("pitch"),
        instr.cast("int").alias("instr"),
    )


def events(spark: SparkSession, sf_dir: str, kinds: str = "mixed") -> DataFrame:
    """Raw token events. ``plain`` leaves out separators and controls."""
    n = notes(spark, sf_dir)
    sep, rest = F.col("event_id") % 97 == 0, F.col("event_id") % 17 == 0
    shift = F.when(F.col("event_id") % 11 == 0, V.ANTICIPATED).otherwise(0)
    note = F.when(rest, V.REST).otherwise(V.NOTE + V.MAX_PITCH * F.col("instr") + F.col("pitch") + shift)
    moved = F.when(rest, 0).otherwise(shift)
    rows = n.select(
        "seq_id",
        "ev_idx",
        F.when(sep, V.SEP).otherwise(F.col("t") + moved).cast("int").alias("time"),
        F.when(sep, V.SEP).otherwise(F.when(rest, V.DURATION).otherwise(F.col("d") + V.DURATION + moved)).cast("int").alias("dur"),
        F.when(sep, V.SEP).otherwise(note).cast("int").alias("note"),
    )
    return rows.where(F.col("note") < V.ANTICIPATED) if kinds == "plain" else rows


def sequences(spark: SparkSession, sf_dir: str, kinds: str = "mixed") -> DataFrame:
    return to_sequences(events(spark, sf_dir, kinds), lead=V.AR)


def token_text(tokens: Column) -> Column:
    return F.array_join(tokens.cast("array<string>"), " ")


_CASES = " ".join(f"WHEN '{k}' THEN {v}" for k, v in INSTRUMENTS.items())

BASE_SQL = f"""
WITH notes AS (
    SELECT user_id AS seq_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INTEGER) AS ev_idx,
           CAST(least(floor((epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY user_id)) / 260000000), 9999) AS INTEGER) AS t,
           CAST(least(floor(value), 999) AS INTEGER) AS d, CAST(event_id % 128 AS INTEGER) AS pitch,
           CAST(CASE event_type {_CASES} ELSE 0 END AS INTEGER) AS instr,
           event_id % 97 = 0 AS sep, event_id % 17 = 0 AS rest, CASE WHEN event_id % 11 = 0 AND event_id % 17 <> 0 THEN 27513 ELSE 0 END AS shift
    FROM events
), ev AS (
    SELECT seq_id, ev_idx,
           CAST(CASE WHEN sep THEN 55025 ELSE t + shift END AS INTEGER) AS time,
           CAST(CASE WHEN sep THEN 55025 WHEN rest THEN 10000 ELSE d + 10000 + shift END AS INTEGER) AS dur,
           CAST(CASE WHEN sep THEN 55025 WHEN rest THEN 27512 ELSE 11000 + 128 * instr + pitch + shift END AS INTEGER) AS note
    FROM notes
), plain AS (SELECT * FROM ev WHERE note < 27513),
seqs AS (SELECT seq_id, [55026] || flatten(list([time, dur, note] ORDER BY ev_idx)) AS tokens FROM ev GROUP BY seq_id),
plain_seqs AS (SELECT seq_id, [55026] || flatten(list([time, dur, note] ORDER BY ev_idx)) AS tokens FROM plain GROUP BY seq_id),
tok AS (SELECT seq_id, unnest(tokens) AS tok, generate_subscripts(tokens, 1) - 1 AS pos FROM seqs)
"""
