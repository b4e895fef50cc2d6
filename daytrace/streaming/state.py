"""Keyed state machines over streams; drained, they give the batch operators' rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor

from daytrace.config import US, Thresholds

#: State stores that can append to a list without rewriting it (see ``jobs.run``).
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Attribution(StatefulProcessor):
    """Signals wait in a list until the watermark passes them, then move the device's state in order."""

    columns = ["user_id", "device_id", "us", "type", "domain"]

    def __init__(self, wake_bound_us: int | None):
        self.bound = wake_bound_us

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getListState(
            "waiting", "us bigint, seq bigint, kind string, domain string, focused boolean, active boolean"
        )
        self.now = handle.getValueState("now", "domain string, focused boolean, active boolean, seen bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = 0
        for frame in rows:
            add = _tuples(frame, ["us", "seq", "kind", "domain", "focused", "active"])
            newest = max(newest, *(r[0] for r in add))
            self.waiting.appendList(add)
        self.handle.registerTimer(-(-newest // 1000))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows = sorted(self.waiting.get(), key=lambda r: r[:2])
        due = [r for r in rows if r[0] <= passed]
        later = rows[len(due):]
        if due and later:
            self.waiting.put(later)
        elif due:
            self.waiting.clear()
        domain, focused, active, seen = self.now.get() if self.now.exists() else ("", False, True, 0)
        shown = domain if focused and active else ""
        out = []
        for us, _, kind, d, f, a in due:
            if self.bound is not None and seen and us - seen > self.bound:
                if shown:
                    out.append((*key, seen, "DOMAIN_FOCUS_END", shown))
                domain, focused, active, shown = "", False, True, ""
            if kind == "tab":
                domain = d or ""
            elif kind == "focus":
                focused = bool(f)
            elif kind == "idle":
                active = bool(a)
            before, shown = shown, domain if focused and active else ""
            if before != shown:
                out += [(*key, us, "DOMAIN_FOCUS_END", before)] if before else []
                out += [(*key, us, "DOMAIN_FOCUS_START", shown)] if shown else []
            seen = us
        forgets = None if self.bound is None or not seen else seen + self.bound
        if not shown and not later and (not seen or (forgets is not None and forgets <= passed)):
            self.now.clear()  # the next signal starts anew in any case
        elif due:
            self.now.update((domain, focused, active, seen))
            if forgets is not None and not shown:
                self.handle.registerTimer(forgets // 1000 + 1)
        if out:
            yield pd.DataFrame(out, columns=self.columns)


class _Sessions(StatefulProcessor):
    """The events of a device-day are appended to a list; a timer at the day's end cuts them into sessions."""

    def __init__(self, cut: Callable[[Iterable[tuple]], list[tuple]], columns: list[str]):
        self.cut, self.columns = cut, columns

    def init(self, handle) -> None:
        self.handle = handle
        self.events = handle.getListState("events", "us bigint, seq bigint, type string, key string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:
            self.events.appendList(_tuples(frame, ["us", "seq", "type", "key"]))
        self.handle.registerTimer(int(frame["day_end_us"].iloc[0] // 1000))  # one timer, however often it is set
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = self.cut(self.events.get())
        self.events.clear()
        if out:
            yield pd.DataFrame([(*key, *s) for s in out], columns=self.columns)


def _tuples(frame: pd.DataFrame, columns: list[str]) -> list[tuple]:
    """Rows as plain values, missing ones as None."""
    values = ([None if v != v else v for v in frame[c].tolist()] for c in columns)  # NaN, NaT are not themselves
    return list(zip(*values))


def stream_attribution(signals: DataFrame, wake_bound_us: int | None = None) -> DataFrame:
    """Focus events from a stream of signals, one state per device.

    ``signals`` needs an event-time column ``ts`` with a watermark.  Rows may come in any order until the
    watermark passes them: they are held, then taken in (us, seq) order.  The state of a device is what
    is held and four values; with ``wake_bound_us`` it ends once the watermark is that far past the last
    signal, unless a domain is still in focus, whose end the next signal gives.  Spark drops rows behind the
    watermark before they get here; ``jobs.split_late`` diverts them.  Run it by ``jobs.run``.
    """
    return signals.groupBy("user_id", "device_id").transformWithStateInPandas(
        _Attribution(wake_bound_us),
        "user_id long, device_id int, us long, type string, domain string",
        "Append",
        "EventTime",
    )


def stream_sessions(events: DataFrame, th: Thresholds) -> DataFrame:
    """App sessions from a stream, one state per device-day.

    ``events`` needs day_end_us and an event-time column ``ts`` with a watermark.  Rows may come in
    any order until the watermark passes the day's end: a micro-batch appends its own rows to the state,
    what is there is not written again.  A timer at the day's end cuts them into sessions in (us, seq)
    order and ends the state.  Spark drops rows behind the watermark before they get here;
    ``jobs.split_late`` diverts them.  Run it by ``jobs.run``.
    """
    from daytrace.operators.sessions import APP

    least, cap, gap = th.min_session_s * US, th.max_session_s * US, th.merge_gap_s * US
    opens, same, closers, touch = APP.opens, APP.closes_same, set(APP.closes_any), APP.interaction
    cols = [
        "user_id", "device_id", "local_date", "app_key", "start_us", "end_us", "interactions",
        "truncated", "merged_from",
    ]

    def finish(held, app, start, count, end, at_end, out):
        """Close a raw session; returns the session now held back for merging."""
        truncated = end - start > cap or at_end
        end = min(end, start + cap)
        if end - start < least:
            return held
        if held and held[0] == app and start - held[2] < gap:
            return (app, held[1], end, held[3] + count, truncated, held[5] + 1)
        if held:
            out.append(held)
        return (app, start, end, count, truncated, 1)

    def sessions(rows):
        app, start, count, last = "", 0, 0, 0
        held, out = None, []
        for us, _, kind, name in sorted(rows, key=lambda r: r[:2]):
            last = us
            if kind == opens and name is not None:
                if app != name:
                    if app:
                        held = finish(held, app, start, count, us, False, out)
                    app, start, count = name, us, 0
            elif kind in closers or (kind == same and name == app):
                if app:
                    held = finish(held, app, start, count, us, False, out)
                app, start, count = "", 0, 0
            elif kind == touch and app:
                count += 1
        if app:
            held = finish(held, app, start, count, last, True, out)
        return [*out, held] if held else out

    return events.groupBy("user_id", "device_id", "local_date").transformWithStateInPandas(
        _Sessions(sessions, cols),
        "user_id long, device_id int, local_date date, app_key string, start_us long, end_us long, "
        "interactions long, truncated boolean, merged_from long",
        "Append",
        "EventTime",
    )
