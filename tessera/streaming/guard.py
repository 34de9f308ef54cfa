"""A guard of tasks' plans: one automaton a task, fed by plans that change and calls that are made.

A plan is a list of steps, some of them gates. A call is the first step of its
tool, and of its argument if the step has one, that is not done; else one that
is done; else it is free. It is blocked, and so not done, while a gate that
stands before its step is open. A task is forgotten ``EXPIRY`` seconds after
its plan came: a call later than that is free, and a timer of event time drops
the state of a task that is never called again. The same automaton runs over a
stream, from a checkpoint after a restart, and over a table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Seconds that a plan holds; the tool that is a gate.
EXPIRY, GATE = 1800, "task_gate_check"
#: What a row is: kind is plan (``steps`` counts), call (``tool`` and ``arg`` count) or clear.
EVENT = "task string, seq long, ts timestamp, kind string, steps array<struct<step string, tool string, arg string>>, tool string, arg string"
VERDICT = "task string, seq long, verdict string, step string, gate string, next string"


@dataclass
class Guard:
    """The state of one task: its steps as (step, tool, arg), the places that are done, and when the plan came."""

    steps: list[tuple[str, str, str]] | tuple[tuple[str, str, str], ...] = field(default_factory=list)
    done: list[int] = field(default_factory=list)
    since: float | None = None

    def plan(self, steps, at: float) -> None:
        self.steps, self.done, self.since = [(s["step"], s["tool"], s["arg"] or "") for s in steps if s is not None], [], at

    def clear(self) -> None:
        self.steps, self.done, self.since = [], [], None

    def call(self, tool: str | None, arg: str | None, at: float) -> tuple[str, str | None, str | None, str | None]:
        """(verdict, step, open gate, first step to do before it)."""
        if self.since is None:
            return "free", None, None, None
        if at - self.since > EXPIRY:
            self.clear()
            return "expired", None, None, None
        fits = [i for i, (_, t, a) in enumerate(self.steps) if t == tool and (not a or a == arg)]
        if not fits:
            return "free", None, None, None
        new = [i for i in fits if i not in self.done]
        own = (new or fits)[0]
        gate = next((i for i in range(own) if self.steps[i][1] == GATE and i not in self.done), None)
        if gate is not None:
            first = next(i for i in range(gate + 1) if i not in self.done)
            return "blocked", self.steps[own][0], self.steps[gate][0], self.steps[first][0]
        if new:
            self.done.append(own)
        return "allowed" if new else "again", self.steps[own][0], None, None

    def take(self, row) -> tuple | None:
        at = row.ts.timestamp()
        if row.kind == "plan":
            self.plan(row.steps if row.steps is not None else [], at)
        elif row.kind == "clear":
            self.clear()
        elif row.kind == "call":
            return (row.task, row.seq, *self.call(row.tool, row.arg, at))
        return None


_COLUMNS = [c.split()[0] for c in VERDICT.split(", ")]


def _ordered(pdf: pd.DataFrame) -> pd.DataFrame:
    return pdf.dropna(subset=["task", "ts"]).sort_values(["ts", "seq"], kind="stable", na_position="first")


class GuardProcessor(StatefulProcessor):
    """The automaton over a stream; rows of one batch go by time, then ``seq``."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("guard", "steps array<string>, tools array<string>, args array<string>, done array<int>, since double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        guard = Guard()
        if self.state.exists():
            steps, tools, args, done, since = self.state.get()
            guard = Guard(list(zip(steps, tools, args)), list(done), since)
        out = [v for row in _ordered(pd.concat(list(rows))).itertuples(index=False) if (v := guard.take(row))]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if guard.since is None:
            self.state.clear()
        else:
            cols = [list(c) for c in zip(*guard.steps)] or [[], [], []]
            self.state.update((*cols, guard.done, guard.since))
            self.handle.registerTimer(int((guard.since + EXPIRY) * 1000) + 1)
        yield pd.DataFrame(out, columns=_COLUMNS).astype({"seq": "int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.state.clear()
        yield pd.DataFrame({c: pd.Series(dtype="int64" if c == "seq" else "object") for c in _COLUMNS})

    def close(self) -> None:
        pass


def guard_stream(events: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """A stream of verdicts, one for each call of ``events`` (``EVENT``). A call or plan later than the watermark still counts, as it comes."""
    rows = events.where("task is not null and ts is not null").withWatermark("ts", lateness)
    return rows.groupBy("task").transformWithStateInPandas(GuardProcessor(), VERDICT, "Append", "EventTime")


@lru_cache(10_000)
def _plan(text: str | None) -> tuple[tuple[str, str, str], ...]:
    """The steps of a plan as JSON: few plans are given to many tasks."""
    return tuple((s.get("step"), s.get("tool"), s.get("arg") or "") for s in json.loads(text or "[]") if s is not None)


def _along(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    guard, task = Guard(), None
    for pdf in batches:
        out = []
        for own, seq, at, kind, steps, tool, arg in zip(*(pdf[c].tolist() for c in pdf.columns)):
            if own != task:
                guard, task = Guard(), own
            if kind == "call":
                out.append((own, seq, *guard.call(tool, arg, at)))
            elif kind == "plan":
                guard.steps, guard.done, guard.since = _plan(steps), [], at
            elif kind == "clear":
                guard.clear()
        yield pd.DataFrame(out, columns=_COLUMNS).astype({"seq": "int64"})


def guard_verdicts(events: DataFrame) -> DataFrame:
    """Verdicts of a table of events: the rows of a task pass one after another, and only its automaton is held.

    Rows without a task or a time are left out; rows of one time go by
    ``seq``. Extra columns are ignored. Plans pass as text, which a worker
    reads once for all tasks that have the same one.
    """
    names = [c.split()[0] for c in EVENT.split(", ")[:4]] + ["steps", "tool", "arg"]
    rows = events.where("task is not null and ts is not null").select(*names)
    rows = rows.withColumn("steps", F.to_json("steps")).repartition("task").sortWithinPartitions("task", "ts", "seq")
    return rows.select("task", "seq", (F.unix_micros("ts") / 1e6).alias("at"), "kind", "steps", "tool", "arg").mapInPandas(_along, VERDICT)


def blocked_share(verdicts: DataFrame) -> DataFrame:
    """(task, calls, blocked, expired) counts of verdicts."""
    return verdicts.groupBy("task").agg(F.count("*").alias("calls"), F.count_if(F.col("verdict") == "blocked").alias("blocked"), F.count_if(F.col("verdict") == "expired").alias("expired"))
