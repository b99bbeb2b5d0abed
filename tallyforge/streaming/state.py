"""Keyed state of streams: listings through their life, and change logs checked event by event as they arrive."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor

from ..operators.chains import GENESIS

#: Fields of a listing that an event sets where it has a value, and the time that the first event of a status sets.
FIELDS = ["title", "price", "offer_id", "listing_id", "url"]
TIMES = {"DRAFTED": "drafted_at", "SYNCED": "synced_at", "PUBLISHED": "published_at", "ENDED": "ended_at", "SHIPPED": "shipped_at"}
LISTING = ["status", *FIELDS, *TIMES.values(), "updated_at"]
_LISTING_SCHEMA = ", ".join(f"{c} string" for c in LISTING)


def use_typed_state(spark: SparkSession) -> None:
    """State of several columns and timers is kept by the RocksDB store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def step(row: dict | None, event: dict) -> dict | None:
    """A listing after an event (status, ts and FIELDS; empty is none): no status is an edit of a listing there is; DRAFTED overwrites no status, SYNCED leaves PUBLISHED."""
    status = event.get("status") or ""
    if row is None:
        if not status:
            return None
        row = dict.fromkeys(LISTING)
    row = row | {f: event[f] for f in FIELDS if event.get(f)}
    if status == "DRAFTED":
        row["status"] = row["status"] or status
    elif status == "SYNCED":
        row["status"] = "PUBLISHED" if row["status"] == "PUBLISHED" else status
    elif status:
        row["status"] = status
    at = TIMES.get(status)
    if at and not row[at]:
        row[at] = event["ts"]
    return row | {"updated_at": event["ts"]}


def _clean(record: dict) -> dict:
    return {k: None if v is None or v is pd.NaT or (isinstance(v, float) and v != v) else v for k, v in record.items()}


class _Listings(StatefulProcessor):
    """One row of state for each sku; events that come before those of a lower pos wait in a map, `patience` ms at most."""

    def __init__(self, patience: int):
        self.patience = patience

    def init(self, handle) -> None:
        self.handle = handle
        self.row = handle.getValueState("listing", f"next long, {_LISTING_SCHEMA}")
        self.waiting = handle.getMapState("waiting", "pos long", f"ts string, status string, {', '.join(f'{f} string' for f in FIELDS)}")

    def _fold(self, key: tuple, skip: bool, now: int) -> Iterator[pd.DataFrame]:
        was = self.row.get() if self.row.exists() else None
        expected, row = (was[0], None if was[-1] is None else dict(zip(LISTING, was[1:], strict=True))) if was is not None else (0, None)
        held = {k[0]: v for k, v in self.waiting.iterator()}
        before = expected
        while held and (expected in held or skip or min(held) < expected):
            pos = min(held)
            event = dict(zip(("ts", "status", *FIELDS), held.pop(pos), strict=True))
            self.waiting.removeKey((pos,))
            if pos >= expected:  # an event that came twice is one
                row, expected = step(row, event), pos + 1
        if expected == before:
            if held and not list(self.handle.listTimers()):
                self.handle.registerTimer(now + self.patience)
            return
        self.row.update((expected, *(row[c] if row else None for c in LISTING)))
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if held:
            self.handle.registerTimer(now + self.patience)
        if row:
            yield pd.DataFrame([[key[0], expected, len(held), *(row[c] for c in LISTING)]], columns=["sku", "next", "waiting", *LISTING])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for r in map(_clean, batch.to_dict("records")):
                self.waiting.updateValue((r["pos"],), tuple(r[c] for c in ("ts", "status", *FIELDS)))
        yield from self._fold(key, False, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._fold(key, True, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def listings(events: DataFrame, patience_ms: int = 600_000) -> DataFrame:
    """(sku, next, waiting, status, fields, times) of a stream of events (sku, pos, ts, status, title, price, offer_id, listing_id, url: strings but pos, from 0).

    A listing's events take effect in the order of pos however they arrive: one that
    is early waits, and is counted, until those before it came or patience_ms went by.
    """
    d = events.select("sku", "pos", "ts", "status", *FIELDS)
    sku = d.schema["sku"].dataType.simpleString()
    return d.groupBy("sku").transformWithStateInPandas(_Listings(patience_ms), f"sku {sku}, next long, waiting long, {_LISTING_SCHEMA}", "Update", "ProcessingTime")


EVENT = ["hash", "body", "prev", "seq", "key", "kind", "fields", "add", "remove", "state"]
_EVENT_SCHEMA = "hash string, body string, prev string, seq long, key string, kind string, fields array<string>, add array<string>, remove array<string>, state string"


def digest(fields: list[str], rows: dict[str, int]) -> str:
    """The digest of operators.chains.state_digest with one shard."""
    body = {"fields": list(fields), "rows": [r for r in sorted(rows) for _ in range(rows[r])]}
    return hashlib.sha256(json.dumps(body, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


class _Chains(StatefulProcessor):
    """Where a chain stands, the rows of its table with their number, and events that came early."""

    def __init__(self, patience: int, states: bool):
        self.patience, self.states = patience, states

    def init(self, handle) -> None:
        self.handle = handle
        self.at = handle.getValueState("at", "events long, head string, reason string")
        self.table = handle.getMapState("table", "row string", "n long")
        self.waiting = handle.getMapState("waiting", "line long", _EVENT_SCHEMA)

    def _wrong(self, chain: str, e: dict, events: int, head: str) -> str | None:
        """What is wrong with the next event, in the order of operators.chains.BREAKS; puts its rows into the table."""
        if e["hash"] is None:
            return "not an event"
        if e["hash"] != hashlib.sha256((e["body"] or "").encode()).hexdigest():
            return "edited"
        if e["prev"] != head:
            return "prev"
        if e["seq"] != events:
            return "seq"
        if e["key"] != chain:
            return "key"
        if (e["kind"] == "genesis") != (events == 0):
            return "genesis"
        for row in e["remove"] if e["remove"] is not None else []:
            n = self.table.getValue((row,))[0] if self.table.containsKey((row,)) else 0
            if n < 1:
                return "removes"
            if n == 1:
                self.table.removeKey((row,))
            else:
                self.table.updateValue((row,), (n - 1,))
        for row in e["add"] if e["add"] is not None else []:
            n = self.table.getValue((row,))[0] if self.table.containsKey((row,)) else 0
            self.table.updateValue((row,), (n + 1,))
        if self.states and e["state"] != digest(e["fields"] if e["fields"] is not None else [], {k[0]: v[0] for k, v in self.table.iterator()}):
            return "state"
        return None

    def _fold(self, key: tuple, late: bool, now: int) -> Iterator[pd.DataFrame]:
        events, head, reason = self.at.get() if self.at.exists() else (0, GENESIS, None)
        held = sorted(k[0] for k, _ in self.waiting.iterator())
        before = (events, reason)
        for line in held:
            if reason is not None or line <= events:
                self.waiting.removeKey((line,))
            elif line == events + 1:
                e = dict(zip(EVENT, self.waiting.getValue((line,)), strict=True))
                self.waiting.removeKey((line,))
                reason = self._wrong(key[0], e, events, head)
                if reason is None:
                    events, head = events + 1, e["hash"]
            elif late:
                reason = "missing"
        left = [] if reason is not None else [line for line in held if line > events]
        if left and not list(self.handle.listTimers()):
            self.handle.registerTimer(now + self.patience)
        elif not left:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
        if (events, reason) != before:
            self.at.update((events, head, reason))
            yield pd.DataFrame({"chain": [key[0]], "events": [events], "head": [head], "line": [None if reason is None else events + 1], "reason": [reason], "waiting": [len(left)]}).astype({"line": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for r in map(_clean, batch.to_dict("records")):
                lists = {c: [] if r[c] is None else [str(x) for x in r[c]] for c in ("fields", "add", "remove")}
                r = r | lists
                self.waiting.updateValue((int(r["line"]),), tuple(None if r[c] is None else int(r[c]) if c == "seq" else r[c] for c in EVENT))
        yield from self._fold(key, False, timerValues.getCurrentProcessingTimeInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._fold(key, True, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def check_chains(events: DataFrame, patience_ms: int = 600_000, states: bool = True) -> DataFrame:
    """(chain, events, head, line, reason, waiting) of a stream of change-log events, as operators.chains.verify takes them.

    Each change of a chain gives a row: its good events so far, their last hash, the
    first break. Events take their turn by line; one that is early waits, and if what
    lies before it has not come after patience_ms the chain is broken there as missing.
    states: the table's digest is computed after every event, not after the last alone.
    """
    d = events.select("chain", "line", *EVENT)
    return d.groupBy("chain").transformWithStateInPandas(_Chains(patience_ms, states), "chain string, events long, head string, line long, reason string, waiting long", "Update", "ProcessingTime")
