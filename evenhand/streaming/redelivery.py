"""Redelivery: failed messages come again with growing delay, and are given up after five.

One small state for each message id: the failed attempts so far and whether the message
is settled. It is dropped by a timer once the watermark has passed the last delivery by
the expiry, so it grows with the messages in flight only.

Messages are dealt by a hash of their id to buckets, and the states of a bucket are kept
together: a batch costs one call for each bucket it touches, not one for each message.
A call reads and writes the states of its bucket's messages in flight.
"""

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

# Deliveries before a message is set aside, and the seconds between which the
# delay doubles.
MAX_ATTEMPTS = 5
LEAST_DELAY, MOST_DELAY = 10, 600
# Groups of messages whose states are kept together; all messages are in one of them.
BUCKETS = 1024

_OUTPUT = "message_id string, raw string, at timestamp, outcome string, attempt int, due_at timestamp"
_STATE = "ids array<string>, attempts array<int>, settled array<boolean>, until array<long>, timer long"


def delay(attempt: int) -> int:
    """Seconds to wait after the ``attempt``-th failure."""
    return min(LEAST_DELAY * 2 ** min(attempt - 1, 30), MOST_DELAY)


def outcomes(code, failed, before, settled, most: int):
    """Outcome and attempt of every delivery, given message by message (``code`` ascending)
    in the order of their times; failures ``before`` and ``settled`` are by code."""
    first = np.r_[True, code[1:] != code[:-1]]
    start = np.flatnonzero(first)[np.cumsum(first) - 1]
    count = before[code] + np.arange(len(code)) - start + 1
    ends = ~failed | (count >= most)
    ended = np.cumsum(ends) - ends
    duplicate = settled[code] | (ended > ended[start])
    live = np.bincount(code[~duplicate], minlength=len(before))
    attempt = np.minimum(count, (before + live)[code])
    outcome = np.select([duplicate, ~failed, count >= most], ["duplicate", "accepted", "dead"], "retry")
    return outcome, attempt


class Attempts(StatefulProcessor):
    """What becomes of each delivery of a bucket's messages, in the order of their times.

    ``accepted`` the first time it succeeds, ``retry`` (with the time it is due again)
    while it fails, ``dead`` when it has failed often enough, and ``duplicate`` for all
    that comes after the message is settled."""

    def __init__(self, most: int, expiry: int):
        self.most, self.expiry = most, expiry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", _STATE)

    def _load(self):
        """Ids of the messages in flight, their states, and when the bucket's timer rings."""
        ids, attempts, settled, until, timer = self.known.get() if self.known.exists() else ([], [], [], [], None)
        return list(ids), np.array(attempts, np.int64), np.array(settled, bool), np.array(until, np.int64), timer

    def _store(self, ids, attempts, settled, until, timer, now: int, rung: bool = False) -> None:
        """Keep what has not expired; the timer rings when the next message does."""
        kept = np.flatnonzero(until >= now)
        due = int(until[kept].min()) if len(kept) else None
        if timer != due:
            if timer is not None and not rung:
                self.handle.deleteTimer(timer)
            if due is not None:
                self.handle.registerTimer(due)
        if due is None:
            self.known.clear()
        else:
            columns = [x[kept].tolist() for x in (attempts, settled, until)]
            self.known.update(([ids[k] for k in kept], *columns, due))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues):  # noqa: N803
        now = timerValues.getCurrentWatermarkInMs()
        some = pd.concat(list(rows), ignore_index=True).sort_values("at", kind="stable", ignore_index=True)
        ids, attempts, settled, until, timer = self._load()
        # codes of known messages are their places; new ones come after
        given = pd.Series([*ids, *some["message_id"]], dtype=object)
        code, ids = pd.factorize(given.where(given.notna(), None), use_na_sentinel=False)
        new = len(ids) - len(attempts)
        code = code[len(attempts) :]
        attempts, settled = np.r_[attempts, np.zeros(new, np.int64)], np.r_[settled, np.zeros(new, bool)]
        until = np.r_[until, np.full(new, np.iinfo(np.int64).min)]

        order = np.argsort(code, kind="stable")
        code, some = code[order], some.iloc[order]
        failed = some["failed"].fillna(False).to_numpy(bool)
        outcome, attempt = outcomes(code, failed, attempts, settled, self.most)
        waits = np.array([delay(k) for k in range(1, int(attempt.max()) + 1)])[attempt - 1]
        due = some["at"] + pd.to_timedelta(waits, unit="s").to_numpy()
        names = np.array([None if x is None or x != x else x for x in ids], object)
        yield pd.DataFrame(
            {
                "message_id": names[code],
                "raw": some["raw"].to_numpy(),
                "at": some["at"].to_numpy(),
                "outcome": outcome,
                "attempt": attempt.astype(np.int32),
                "due_at": due.where(outcome == "retry").to_numpy(),
            }
        )

        np.maximum.at(attempts, code, attempt)
        settled[code[outcome != "retry"]] = True
        at = some["at"].to_numpy().astype("datetime64[ms]")
        # a delivery without a time counts as if it came now
        at = np.where(np.isnat(at), max(now, 0), at.astype(np.int64))
        np.maximum.at(until, code, at + self.expiry * 1000)
        self._store(names.tolist(), attempts, settled, until, timer, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):  # noqa: N803
        self._store(*self._load(), timerValues.getCurrentWatermarkInMs(), rung=True)
        yield from ()

    def close(self) -> None:
        pass


def settle_deliveries(
    deliveries: DataFrame, lateness: str = "1 hour", expiry: int = 7200, most: int = MAX_ATTEMPTS
) -> DataFrame:
    """Outcome of every delivery of a stream with ``message_id``, ``raw``, ``at`` and ``failed``."""
    return (
        deliveries.select("message_id", "raw", "at", "failed")
        .withWatermark("at", lateness)
        .withColumn("bucket", F.pmod(F.xxhash64("message_id"), F.lit(BUCKETS)))
        .groupBy("bucket")
        .transformWithStateInPandas(
            statefulProcessor=Attempts(most, expiry),
            outputStructType=_OUTPUT,
            outputMode="append",
            timeMode="eventTime",
        )
    )
