"""State of single keys in streams: attempts in order of time, limits, lockouts, first uploads.

The state is kept by Spark's state store (RocksDB), so a micro-batch that fails and is run
again begins with the state that it began with.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidemark.streaming.replay import admit, login_steps

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Stands for no time at all.
NEVER = -(1 << 63)


def keep_state(spark: SparkSession) -> None:
    """Set the state store that these processors need, for the session's streams to come."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


class InOrder(StatefulProcessor):
    """Rows (t in microseconds, id, ...) of a key, taken in order of time and id.

    Rows wait until the watermark has passed them: none that is earlier can come any more, so
    whatever order they arrive in, within the lateness that the watermark allows, they are
    decided as a batch would. What waits is what a key got within that time.
    """

    def __init__(self, columns: list[str], waiting: str, output: list[str]):
        self.columns, self.waiting_schema, self.output = columns, waiting, output

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", self.waiting_schema)
        self.begin(handle)

    def begin(self, handle: StatefulProcessorHandle) -> None:
        raise NotImplementedError

    def decide(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        raise NotImplementedError

    def forget(self, key: tuple, watermark: int) -> None:
        """Drop what no row after the watermark (microseconds) needs."""

    def _wake(self, micros: int) -> None:
        self.handle.registerTimer(-(-micros // 1000))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        earliest = None
        for batch in rows:
            new = [tuple(r) for r in batch[self.columns].astype(object).itertuples(index=False, name=None)]
            self.waiting.appendList(new)
            earliest = min([r[0] for r in new] + ([] if earliest is None else [earliest]))
        if earliest is not None:
            self._wake(earliest)
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        held = [tuple(r) for r in self.waiting.get()] if self.waiting.exists() else []
        ready, later = [r for r in held if r[0] <= passed], [r for r in held if r[0] > passed]
        if ready:
            self.waiting.put(later) if later else self.waiting.clear()
            if later:
                self._wake(min(r[0] for r in later))
            out = self.decide(key, sorted(ready, key=lambda r: (r[0], r[1])))
            yield pd.DataFrame(out, columns=self.output, dtype=object)
        self.forget(key, passed)


class SlidingLog(InOrder):
    """Decisions of a sliding log for a key. State: the accepted times of the window, at most as
    many as the limit, and gone once the watermark has passed the window."""

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.accepted = handle.getListState("accepted", "t long, seconds long")

    def decide(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        accepted = deque(t for t, _ in self.accepted.get()) if self.accepted.exists() else deque()
        out = []
        for t, row_id, most, seconds in rows:
            [allowed] = admit([t], accepted, most, seconds * 1_000_000)
            out.append((*key, t, row_id, allowed, most - len(accepted) if allowed else 0, t + seconds * 1_000_000))
        if accepted:
            self.accepted.put([(t, seconds) for t in accepted])
            self._wake(accepted[-1] + seconds * 1_000_000)
        return out

    def forget(self, key: tuple, watermark: int) -> None:
        held = [tuple(r) for r in self.accepted.get()] if self.accepted.exists() else []
        kept = [(t, s) for t, s in held if t + s * 1_000_000 > watermark]
        if len(kept) < len(held):
            self.accepted.put(kept) if kept else self.accepted.clear()


class Lockout(InOrder):
    """Outcomes of a user's login attempts. State: failures, the end of the lock and the last
    login, which begin as they are stored; a user without stored state is not known."""

    def begin(self, handle: StatefulProcessorHandle) -> None:
        self.user = handle.getValueState("user", "is_active boolean, failures long, locked long, seen long")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        row = initialState.iloc[0]
        self.user.update((bool(row["is_active"]), int(row["failures"]), int(row["locked"]), int(row["seen"])))

    def decide(self, key: tuple, rows: list[tuple]) -> list[tuple]:
        known = self.user.exists()
        active, failures, locked, seen = self.user.get() if known else (False, 0, 0, NEVER)
        state, out = {"failures": failures, "locked_until": locked}, []
        for t, row_id, success in rows:
            [(_, outcome, failed)] = login_steps(state, [(row_id, t, known, active, success)])
            seen = t if outcome == "success" else seen
            out.append((key[0], row_id, outcome, failed, state["locked_until"] or None, None if seen == NEVER else seen))
        if known:
            self.user.update((active, state["failures"], state["locked_until"], seen))
        return out


class FirstUpload(StatefulProcessor):
    """The document that holds a content (a key of organisation and hash). State: its id. An
    upload with the id that is held is no duplicate, so an upload that comes again is decided
    as it was; where the document is deleted its content is free for the next one."""

    columns = ["id", "problem", "deleted"]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "id string")

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        self.first.update((str(initialState["id"].min()),))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        first = self.first.get()[0] if self.first.exists() else None
        uploads = []  # of one content in one micro-batch, without the content
        for batch in rows:
            if first is not None and ((batch["id"] == first) & batch["deleted"]).any():
                first = None
            uploads.append(batch[~batch["deleted"]])
        own = pd.concat(uploads) if uploads else pd.DataFrame(columns=[*self.columns])
        good = own[own["problem"].isna()]
        if first is None and len(good):
            first = str(good["id"].min())
        self.first.update((first,)) if first is not None else self.first.clear()
        held = [first if p is None and i != first else None for i, p in zip(own["id"], own["problem"].astype(object).where(own["problem"].notna(), None), strict=True)]
        if len(own):
            yield own.drop(columns="deleted").assign(existing_id=pd.Series(held, index=own.index, dtype=object))

    def close(self) -> None:
        pass
