"""Table functions for SQL: windows and readable events of token sequences.

    SELECT * FROM token_windows(TABLE(sequences) PARTITION BY seq_id, events => 8, step => 2)
    SELECT * FROM token_events(TABLE(sequences) PARTITION BY seq_id)

The input is any table with ``tokens``; its other columns are passed through, so the output's columns depend on it. The
DataFrame forms (``windows``, ``tokens.readable_events``) stay inside the JVM; these are for SQL text.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import udtf
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from seqdrift import vocab as V

# Workers import this without a session, which a schema from text would need.
_SHAPE = {"pos": T.IntegerType(), "special_token": T.StringType(), "onset": T.DoubleType(), "duration": T.DoubleType(), "instrument": T.IntegerType(), "pitch": T.StringType(), "anticipated": T.BooleanType()}
_EVENT = T.StructType([T.StructField(name, kind) for name, kind in _SHAPE.items()])


def _passed(table: AnalyzeArgument, added: list[str]) -> list[T.StructField]:
    """The input's columns but ``tokens``; none may bear the name of an added one."""
    if not table.isTable or "tokens" not in table.dataType.fieldNames():
        raise ValueError("the first argument is a table with a column tokens")
    if not isinstance(table.dataType["tokens"].dataType, T.ArrayType):
        raise ValueError("tokens must be an array")
    kept = [f for f in table.dataType.fields if f.name != "tokens"]
    clash = sorted({f.name for f in kept} & set(added))
    if clash:
        raise ValueError(f"columns {clash} of the input are names of the output")
    return kept


def _positive(name: str, argument: AnalyzeArgument | None, default: int) -> None:
    if argument is not None and (not argument.isConstantExpression or argument.value is None or argument.value < 1):
        raise ValueError(f"{name} must be a constant of at least 1, {default} if left out")


class TokenWindows:
    """(other columns, start, input_ids): each window with the sequence's leading token before it.

    Null or single-token sequences have none; with ``drop_last``, neither has an end shorter than a window.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, events: AnalyzeArgument = None, step: AnalyzeArgument = None, drop_last: AnalyzeArgument = None) -> AnalyzeResult:
        _positive("events", events, V.WINDOW_EVENTS)
        _positive("step", step, V.WINDOW_STRIDE)
        added = [T.StructField("start", T.IntegerType()), T.StructField("input_ids", T.ArrayType(T.IntegerType()))]
        return AnalyzeResult(T.StructType(_passed(rows, ["start", "input_ids"]) + added))

    def eval(self, rows: Row, events: int = V.WINDOW_EVENTS, step: int = V.WINDOW_STRIDE, drop_last: bool = True) -> Iterator[tuple]:
        tokens = rows["tokens"]
        if tokens is None or len(tokens) < 2:
            return
        kept = [rows[c] for c in rows.__fields__ if c != "tokens"]
        width, tail = events * V.stride(False), len(tokens) - 1
        for start in range(0, tail - width + 1 if drop_last else tail, step * V.stride(False)):
            yield (*kept, start, [tokens[0], *tokens[start + 1 : start + 1 + width]])


class TokenEvents:
    """(other columns, pos, special_token, onset, duration, instrument, pitch, anticipated): events as people read them.

    A leading AR or AAR makes a row at position 0, any other leading token none. What a last partial event lacks is null.
    Null and empty sequences have no rows.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument) -> AnalyzeResult:
        return AnalyzeResult(T.StructType(_passed(rows, _EVENT.fieldNames()) + _EVENT.fields))

    def eval(self, rows: Row) -> Iterator[tuple]:
        tokens = rows["tokens"] or []
        kept = [rows[c] for c in rows.__fields__ if c != "tokens"]
        named = bool(tokens) and tokens[0] in LEADING
        if named:
            yield (*kept, 0, LEADING[tokens[0]], None, None, None, None, None)
        k = V.stride(False)
        for i in range(1, len(tokens), k):
            yield (*kept, named + i // k, *_event(*tokens[i : i + k]))


LEADING = {V.AR: "AR", V.AAR: "AAR"}


def _event(time: int, duration: int | None = None, note: int | None = None) -> tuple:
    if V.SEP in (time, duration, note):
        return ("SEP", None, None, None, None, None)
    ahead = V.ANTICIPATED <= time < V.ANTICIPATED_DURATION
    shift = V.ANTICIPATED if ahead else 0
    onset, length = (time - shift) / V.TICKS, None if duration is None else (duration - shift - V.DURATION) / V.TICKS
    if note is None or note == V.REST:
        return (None if note is None else "REST", onset, length, None, None, ahead)
    instrument, pitch = divmod(note - shift - V.NOTE, V.MAX_PITCH)
    if instrument < 0:
        raise ValueError("negative instrument")
    return (None, onset, length, instrument, f"{V.PITCH_NAMES[pitch % 12]}{pitch // 12 - 1}", ahead)


def register(spark: SparkSession) -> None:
    spark.udtf.register("token_windows", udtf(TokenWindows))
    spark.udtf.register("token_events", udtf(TokenEvents))
