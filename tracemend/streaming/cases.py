"""Per-case state on a stream: prefixes, running counts and times that need nothing from other cases."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

FIELDS = "seq long, case_id string, activity string, ts timestamp"
OUT = "seq long, case_id string, activity string, prefix string, so_far long, hours double"


def with_state(events: DataFrame, width: int = 3, idle_days: int = 30, late_days: int = 1) -> DataFrame:
    """Each event (seq, case_id, activity, ts) with its prefix of `width` labels, its number in the case, and hours since the one before.

    State is `width` labels, a count and a time for each case, dropped when the stream's time has passed a case's last
    event by `idle_days`; events over `late_days` behind the stream may be dropped. Events of a micro-batch are taken by seq.
    """

    def step(key, frames: Iterator, state):
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        tail, n, last = state.get if state.exists else ([], 0, None)
        tail = list(tail)
        pdf = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = []
        for seq, activity, ts in zip(pdf["seq"], pdf["activity"], pdf["ts"], strict=True):
            out.append((seq, key[0], activity, ">".join(([""] * width + tail)[-width:]), n, 0.0 if last is None else min((ts - last).total_seconds() / 3600, 24.0)))
            tail, n, last = [*tail, activity if isinstance(activity, str) else "?"][-width:], n + 1, ts
        state.update((tail, n, last))
        newest = max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs())
        state.setTimeoutTimestamp(newest + idle_days * 86_400_000)
        yield pd.DataFrame(out, columns=["seq", "case_id", "activity", "prefix", "so_far", "hours"])

    grouped = events.select("seq", "case_id", "activity", "ts").withWatermark("ts", f"{late_days} days").groupBy("case_id")
    return grouped.applyInPandasWithState(step, OUT, "tail array<string>, n long, last timestamp", "append", "EventTimeTimeout")


HISTORY = "seq long, case_id string, prefix string, provenances string, so_far long, labels long, age double, mean double, deviation double"


def with_history(events: DataFrame, width: int = 3, idle_days: int = 30, late_days: int = 1) -> DataFrame:
    """Each event (seq, case_id, activity, ts, value) with the case's history: the `width` labels before it and their provenances, events
    and distinct labels so far, hours since its first event, mean and deviation of the last `width` values, its own among them.

    State of a case: `width` labels and values, a count, its labels, two times; dropped as in with_state.
    """

    def step(key, frames: Iterator, state):
        import numpy as np
        import pandas as pd

        if state.hasTimedOut:
            state.remove()
            return
        tail, values, n, labels, first, last = state.get if state.exists else ([], [], 0, [], None, None)
        tail, values, labels = list(tail), list(values), list(labels)
        pdf = pd.concat(list(frames)).sort_values("seq", kind="stable")
        out = []
        for seq, activity, ts, value in zip(pdf["seq"], pdf["activity"], pdf["ts"], pdf["value"], strict=True):
            first, last = ts if first is None else first, ts if last is None else max(last, ts)
            if value == value and value is not None:
                values = [*values, float(value)][-width:]
            padded = ([""] * width + tail)[-width:]
            known = isinstance(activity, str)
            came = ",".join("MISSING" if t == "?" else "NORMAL" for t in tail)
            out.append((seq, key[0], ">".join(padded), came, n, len(labels), (ts - first).total_seconds() / 3600, float(np.mean(values)) if values else None, float(np.std(values)) if values else None))
            if known and activity not in labels:
                labels.append(activity)
            tail, n = [*tail, activity if known else "?"][-width:], n + 1
        state.update((tail, values, n, labels, first, last))
        newest = max(int(last.timestamp() * 1000), state.getCurrentWatermarkMs())
        state.setTimeoutTimestamp(newest + idle_days * 86_400_000)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in HISTORY.split(", ")])

    grouped = events.select("seq", "case_id", "activity", "ts", "value").withWatermark("ts", f"{late_days} days").groupBy("case_id")
    return grouped.applyInPandasWithState(step, HISTORY, "tail array<string>, values array<double>, n long, labels array<string>, first timestamp, last timestamp", "append", "EventTimeTimeout")
