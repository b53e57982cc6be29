"""Stateful streams: chat threads that move between modes, loans that end by themselves, and windows over events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.serving import PATIENCE

THREAD = "thread string, seq long, mode string, book_id string, history_length int"
LOAN = "loan string, status string, at timestamp"


def _thread(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    book, length = state.get if state.exists else (None, 0)
    rows = pd.concat(list(batches)).sort_values("seq")
    out = []
    for seq, focus, leave in zip(rows["seq"], rows["focus_book"], rows["leave"], strict=True):
        if isinstance(focus, str) or leave:
            book, length = (focus if isinstance(focus, str) else None), 0
        length += 1
        out.append((key[0], seq, "book" if book else "global", book, length))
    state.update((book, length))
    yield pd.DataFrame(out, columns=["thread", "seq", "mode", "book_id", "history_length"])


def thread_stream(events: DataFrame) -> DataFrame:
    """Mode, book and messages since the last focus after each event (thread, seq, focus_book, leave); state is two values."""
    return events.groupBy("thread").applyInPandasWithState(_thread, THREAD, "book string, length int", "append", GroupStateTimeout.NoTimeout)


READING = "thread string, seq long, mode string, book_id string, history_length int, reply string, waiting int"


class Reader(StatefulProcessor):
    """A thread that reads chapters in parts: mode and book as a value, the parts that wait as a list, and a timer.

    The state is what `serving.reading_states` says of a table; the timer only frees parts that nobody asks for any more.
    """

    def __init__(self, patience: int = PATIENCE):
        self.patience = patience

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "at long, book string, length int")
        self.parts = handle.getListState("waiting", "part string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: object) -> Iterator[pd.DataFrame]:  # noqa: N803
        last, book, length = self.seen.get() if self.seen.exists() else (None, None, 0)
        waiting = [r[0] for r in self.parts.get()] if self.parts.exists() else []
        before, out = list(waiting), []
        for r in pd.concat(list(rows)).sort_values("seq").itertuples(index=False):
            now = int(r.at.timestamp())
            if last is not None and now - last > self.patience:
                waiting = []
            if isinstance(r.focus_book, str) or r.leave:
                book, length, waiting = (r.focus_book if isinstance(r.focus_book, str) else None), 0, []
            reply = None
            if r.parts is not None:
                waiting = list(r.parts)
            if waiting and (r.parts is not None or r.more):
                reply = waiting.pop(0)
            length, last = length + 1, now
            out.append((key[0], r.seq, "book" if book else "global", book, length, reply, len(waiting)))
        self.seen.update((last, book, length))
        if waiting != before:
            self.parts.put([(p,) for p in waiting]) if waiting else self.parts.clear()
        for due in list(self.handle.listTimers()):
            self.handle.deleteTimer(due)
        if waiting:
            self.handle.registerTimer(1000 * (last + self.patience + 1))
        yield pd.DataFrame(out, columns=["thread", "seq", "mode", "book_id", "history_length", "reply", "waiting"])

    def handleExpiredTimer(self, key: tuple, timerValues: object, expiredTimerInfo: object) -> Iterator[pd.DataFrame]:  # noqa: N803
        self.parts.clear()
        return iter(())

    def close(self) -> None:
        pass


def reading_stream(events: DataFrame, patience: int = PATIENCE, late: str = "1 hour") -> DataFrame:
    """READING after each event (thread, seq, at, focus_book, leave, parts, more); at is a timestamp, parts an array.

    It needs a state store with maps and lists: spark.sql.streaming.stateStore.providerClass must name RocksDB's.
    """
    return events.withWatermark("at", late).groupBy("thread").transformWithStateInPandas(Reader(patience), READING, "Append", "EventTime")


def _loan(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        due = state.get[0]
        state.remove()
        yield pd.DataFrame([(key[0], "auto-returned", due)], columns=["loan", "status", "at"])
        return
    rows = pd.concat(list(batches)).sort_values("at")
    for kind, at, due in zip(rows["kind"], rows["at"], rows["due"], strict=True):
        if kind == "checkout":
            state.update((due,))
            yield pd.DataFrame([(key[0], "active", at)], columns=["loan", "status", "at"])
        elif kind == "return" and state.exists:
            state.remove()
            yield pd.DataFrame([(key[0], "returned", at)], columns=["loan", "status", "at"])
    if state.exists:
        due = pd.Timestamp(state.get[0])
        due = due.tz_localize("UTC") if due.tzinfo is None else due
        state.setTimeoutTimestamp(max(int(due.timestamp() * 1000), state.getCurrentWatermarkMs() + 1))


def loan_stream(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Status changes of loans from events (loan, kind, at, due): a loan not returned when event time passes `due` ends."""
    return events.withWatermark("at", late).groupBy("loan").applyInPandasWithState(_loan, LOAN, "due timestamp", "append", GroupStateTimeout.EventTimeTimeout)


def event_windows(events: DataFrame, at: str, keys: list[str], every: str = "1 hour", late: str = "2 hours", value: Column | None = None) -> DataFrame:
    """Extension: counts and sums of tumbling windows, closed once the watermark passes them."""
    total = F.sum(value if value is not None else F.lit(1)).alias("total")
    return events.withWatermark(at, late).groupBy(F.window(at, every), *keys).agg(F.count(F.lit(1)).alias("events"), total)
