"""The sitemap policy as keyed state (ST4), for checks that come in any order within a lateness."""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import groupby
from types import SimpleNamespace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from coverline.operators.health import NEW_POLICY, POLICY, policy_rows, policy_step

OUT = f"{POLICY}, blocked boolean"
HOUR_MS = 3_600_000
#: Outlets share the state of one of so many groups: each group costs a fixed time a batch, and each entry of the store a round trip.
GROUPS = 1_024
#: An entry of the store holds checks of one hour, or of hours in a row until they are so many.
ENTRY = 256


def _micros(t: pd.Timestamp | None) -> int | None:
    return None if t is None else t.value // 1000


def _moment(micros: int | None) -> pd.Timestamp | None:
    return None if micros is None else pd.Timestamp(micros, unit="us")


def _hour(check: list) -> int:
    return check[0] // 1000 // HOUR_MS


def _packed(now: dict) -> list:
    return [now["status"], now["reason"], now["consecutive_failures"], now["last_status_code"], _micros(now["disabled_until"]), _micros(now["updated_at"])]


def _unpacked(status: str, reason: str | None, failures: int, last: int | None, until: int | None, updated: int | None) -> dict:
    return {"status": status, "reason": reason, "consecutive_failures": failures, "last_status_code": last, "disabled_until": _moment(until), "updated_at": _moment(updated)}


def _stepped(now: dict, check: list) -> dict:
    ran_at, i, ok, status, failure, twin, _ = check
    return policy_step(now, SimpleNamespace(ran_at=_moment(ran_at), id=i, ok=ok, status_code=status, failure=failure, twin=twin))


def _entries(checks: list[list]) -> list[list[list]]:
    """Checks in order of time, as entries of the store."""
    out: list[list[list]] = []
    for _, hour in groupby(checks, _hour):
        found = list(hour)
        if out and len(out[-1]) + len(found) <= ENTRY:
            out[-1] += found
        else:
            out.append(found)
    return out


class Policy(StatefulProcessor):
    """A group of outlets. Their checks wait until the watermark has passed their hour; then they are folded in order of time.

    What is held at once are the group's outlets and the checks of one hour, with the rest of the entries it lies in; all
    others lie in the state store. Every batch tells the policy that all checks so far make, waiting ones included, of each
    outlet it has checks of. Timers settle an hour when it is over and tell when a pause ends.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "outlets string")
        self.waiting = handle.getMapState("waiting", "hour long, part long", "checks string")

    def _outlets(self) -> tuple[dict[str | None, dict], dict[str | None, int]]:
        """The settled policies, and the ends of the pauses that were told last."""
        rows = json.loads(self.settled.get()[0]) if self.settled.exists() else []
        return {outlet: _unpacked(*policy) for outlet, policy, _ in rows if policy}, {outlet: told for outlet, _, told in rows if told is not None}

    def _store(self, settled: dict, told: dict) -> None:
        rows = [(o, _packed(settled[o]) if o in settled else None, told.get(o)) for o in {**settled, **told}]
        self.settled.update((json.dumps(rows),))

    def _wait(self, checks: list[list], part: int) -> list[tuple[int, int]]:
        keys = []
        for entry in _entries(checks):
            keys.append((_hour(entry[0]), part))
            self.waiting.updateValue(keys[-1], (json.dumps(entry),))
        return keys

    def _settle(self, keys: list[tuple[int, int]], settled: dict, wanted: set, watermark: int) -> tuple[dict, int | None]:
        """Folds the hours that are over into ``settled``; returns the policies of the ``wanted`` with the waiting ones folded too, and the first hour that waits."""
        keys, at, by_hour, first = sorted(keys), 0, {}, None
        now = None
        while at < len(keys) or by_hour:
            hour = min([*by_hour, *(k[0] for k in keys[at : at + 1])])
            over = (hour + 1) * HOUR_MS <= watermark
            if not over and now is None:
                first, now = hour, {o: settled.get(o, dict(NEW_POLICY)) for o in wanted}
                if not wanted:
                    break
            while at < len(keys) and keys[at][0] == hour:
                checks = json.loads(self.waiting.getValue(keys[at])[0])
                for check in checks:
                    by_hour.setdefault(_hour(check), []).append(check)
                if over:
                    self.waiting.removeKey(keys[at])
                    rest = [c for c in checks if (_hour(c) + 1) * HOUR_MS > watermark]
                    if rest:
                        self.waiting.updateValue((_hour(rest[0]), keys[at][1]), (json.dumps(rest),))
                at += 1
            for check in sorted(by_hour.pop(hour), key=lambda c: (*c[:3], str(c[3:]))):
                outlet = check[6]
                if over:
                    settled[outlet] = _stepped(settled.get(outlet, NEW_POLICY), check)
                elif outlet in wanted:
                    now[outlet] = _stepped(now[outlet], check)
        return {o: settled.get(o, dict(NEW_POLICY)) for o in wanted} if now is None else now, first

    def _told(self, keys: list[tuple[int, int]], settled: dict, told: dict, wanted: set, watermark: int) -> Iterator[pd.DataFrame]:
        now, first = self._settle(keys, settled, wanted, watermark)
        for outlet in wanted:
            until = _micros(now[outlet]["disabled_until"])
            if until is not None and until > watermark * 1000:
                told[outlet] = until
            else:
                told.pop(outlet, None)
        self._store(settled, told)
        if first is not None:
            self.handle.registerTimer((first + 1) * HOUR_MS)
        if told:
            self.handle.registerTimer(min(told.values()) // 1000 + 1)
        if wanted:
            rows = [{"outlet_id": None if o is None else int(o), **now[o], "blocked": o in told} for o in wanted]
            yield pd.DataFrame(rows).astype({"outlet_id": "Int64", "disabled_until": "datetime64[us]", "updated_at": "datetime64[us]", "last_status_code": "Int32"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        keys, wanted = list(self.waiting.keys()), set()
        part = max((p for _, p in keys), default=-1)
        for batch in rows:
            part += 1
            micros = batch["ran_at"].astype("datetime64[us]").astype("int64").tolist()
            codes = [None if pd.isna(x) else int(x) for x in batch["status_code"]]
            failures, outlets = ([x if isinstance(x, str) else None for x in batch[c]] for c in ("failure", "outlet"))
            checks = [list(c) for c in zip(micros, batch["id"].tolist(), batch["ok"].tolist(), codes, failures, batch["twin"].tolist(), outlets)]
            keys += self._wait(sorted(checks, key=lambda c: c[0]), part)
            wanted.update(outlets)
        yield from self._told(keys, *self._outlets(), wanted, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        watermark = timerValues.getCurrentWatermarkInMs()
        settled, told = self._outlets()
        ended = {o for o, until in told.items() if until // 1000 < watermark}
        yield from self._told(list(self.waiting.keys()), settled, told, ended, watermark)

    def close(self) -> None:
        pass


def policy_stream(runs: DataFrame, late: str = "2 hours", twins: DataFrame | None = None) -> DataFrame:
    """The policy of every outlet after each batch that has checks of it, and once more, not blocked, when its pause ends.

    Checks may come ``late``; those that come later are dropped. ``ran_at`` is a timestamp. Needs the RocksDB state store
    (``streaming.jobs.drained`` sets it for its run).
    """
    rows = policy_rows(runs.withWatermark("ran_at", late), twins)
    rows = rows.select(F.pmod(F.xxhash64("outlet_id"), F.lit(GROUPS)).alias("group"), F.col("outlet_id").cast("string").alias("outlet"), "id", "ran_at", "ok", "status_code", "failure", "twin")
    return rows.groupBy("group").transformWithStateInPandas(Policy(), OUT, "update", "EventTime")
