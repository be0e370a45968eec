"""The life of an audit as one keyed state machine: crawling, analyzing, then done or failed.

Per audit the state holds its options, the places taken of its budget, the pages outstanding, and a map of the addresses seen. Events are

- ``start``: url is the start page, links are seeds at depth 1, with max_pages and max_depth;
- ``page``: a page that was queued is finished, with the links that it has or the error that it ended in;
- ``analyzed``: the analysis is finished, with an error if it failed.

Rows that come out are ``enqueue`` (an address and its depth), ``status`` (a transition) and ``ignored`` (an event that no transition takes: a
page that wasn't queued, one that was finished before, a second start, anything after the end).

An address is queued once; what a page asks for beyond the budget is refused and the places that were reserved for it are given back. A start page that
fails ends its audit; a later one that fails is finished, with its message kept. Addresses are forgotten after a day, and an audit of
which nothing is heard for a day has failed. The processor needs the RocksDB state store (``use_rocksdb``).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

EVENT = "audit_id string, kind string, url string, depth int, links array<string>, error string, max_pages int, max_depth int"
ACTION = "audit_id string, action string, url string, depth int, status string, error string, used int, outstanding int"
_STATE = "status string, error string, max_pages int, max_depth int, used int, outstanding int"
DAY_MS = 24 * 60 * 60 * 1000
#: An error that is no failure: robots exclude the page (a fixed text).
BLOCKED = "blocked_by_robots_txt"
SILENT = "nothing heard for a day"


def use_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class AuditMachine(StatefulProcessor):
    """Events of one audit to actions; see the module."""

    def __init__(self, ttl_ms: int = DAY_MS):
        self.ttl_ms = ttl_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.audit = handle.getValueState("audit", _STATE)
        self.seen = handle.getMapState("seen", "url string", "finished boolean", self.ttl_ms)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = self.audit.get()
        state = None if held is None else dict(zip(("status", "error", "max_pages", "max_depth", "used", "outstanding"), held, strict=True))
        out: list[tuple] = []
        for frame in rows:
            for event in frame.to_dict("records"):
                state = self._step(state, {k: _plain(v) for k, v in event.items()}, out)
        if state is not None:
            self.audit.update(tuple(state.values()))
            for at in list(self.handle.listTimers()):
                self.handle.deleteTimer(at)
            if state["status"] in ("crawling", "analyzing"):
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.ttl_ms)
            else:
                self.seen.clear()
        yield _frame(key[0], state, out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = self.audit.get()
        out: list[tuple] = []
        state = None if held is None else dict(zip(("status", "error", "max_pages", "max_depth", "used", "outstanding"), held, strict=True))
        if state is not None and state["status"] in ("crawling", "analyzing"):
            _move(state, "failed", out, SILENT)
            self.audit.update(tuple(state.values()))
            self.seen.clear()
        yield _frame(key[0], state, out)

    def _step(self, state: dict | None, event: dict, out: list[tuple]) -> dict | None:
        kind, url = event["kind"], event["url"]
        if kind == "start" and state is None and url is not None:
            state = {"status": "queued", "error": None, "max_pages": int(event["max_pages"] or 0), "max_depth": int(event["max_depth"] or 0), "used": 0, "outstanding": 0}
            _move(state, "crawling", out)
            self._enqueue(state, [url], 0, out)
            self._enqueue(state, event["links"] or [], 1, out)
            if not state["outstanding"]:
                _move(state, "analyzing", out)
        elif kind == "page" and state is not None and state["status"] == "crawling" and self._waiting(url):
            self.seen.updateValue((url,), (True,))
            error, depth = event["error"], int(event["depth"] or 0)
            if error is not None and error != BLOCKED and depth == 0:
                _move(state, "failed", out, error)
                return state
            if error is None and depth < state["max_depth"]:
                self._enqueue(state, event["links"] or [], depth + 1, out)
            elif error is not None and error != BLOCKED:
                state["error"] = error
            state["outstanding"] -= 1
            if state["outstanding"] <= 0:
                _move(state, "analyzing", out)
        elif kind == "analyzed" and state is not None and state["status"] == "analyzing":
            _move(state, "failed" if event["error"] is not None else "done", out, event["error"])
        else:
            out.append(("ignored", url, event["depth"], None, None))
        return state

    def _waiting(self, url: str | None) -> bool:
        """Whether an address is queued and not finished."""
        return url is not None and self.seen.containsKey((url,)) and not self.seen.getValue((url,))[0]

    def _enqueue(self, state: dict, links: list[str], depth: int, out: list[tuple]) -> None:
        """Queue the new ones among links, as far as the budget goes."""
        new = [u for u in dict.fromkeys(links) if u is not None and not self.seen.containsKey((u,))]
        state["used"] += len(new)
        over = min(len(new), max(0, state["used"] - state["max_pages"]))
        state["used"] -= over
        for i, u in enumerate(new):
            # what is refused has been seen all the same, but nothing waits for it
            taken = i < len(new) - over
            self.seen.updateValue((u,), (not taken,))
            if taken:
                out.append(("enqueue", u, depth, None, None))
        state["outstanding"] += len(new) - over


def _plain(value):
    """A cell of a pandas row as a plain value, None where missing."""
    if value is None or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "tolist"):
        return value.tolist()
    return value


def _move(state: dict, status: str, out: list[tuple], error: str | None = None) -> None:
    state["status"] = status
    if error is not None:
        state["error"] = error
    out.append(("status", None, None, status, state["error"]))


def _frame(audit_id: str, state: dict | None, out: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame(out, columns=["action", "url", "depth", "status", "error"])
    made.insert(0, "audit_id", audit_id)
    made["depth"] = made["depth"].astype("Int32")
    made["used"] = pd.array([state and state["used"]] * len(made), dtype="Int32")
    made["outstanding"] = pd.array([state and state["outstanding"]] * len(made), dtype="Int32")
    return made


def actions(events: DataFrame, ttl_ms: int = DAY_MS) -> DataFrame:
    """The actions that a stream of events asks for. Output mode: append (update also works)."""
    use_rocksdb(events.sparkSession)
    return events.where("audit_id IS NOT NULL").groupBy("audit_id").transformWithStateInPandas(statefulProcessor=AuditMachine(ttl_ms), outputStructType=ACTION, outputMode="Append", timeMode="ProcessingTime")
