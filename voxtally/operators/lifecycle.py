"""The legal order of a request's states, checked over event logs of any size.

The life of a request is a run of a finite automaton: an event moves the request to its
state if that is a legal next one, else the event is illegal and the request stays where
it is. What a stretch of events does is a function from the state before to the state
after, and two such functions compose to one. So the events are put into the order of
(request, time, event) by ranges, every range is cut into chunks, and each chunk
tells what it does to its first and to its last request; only those can go on in another chunk.
The functions of a request that spans many chunks are composed by doubling, and then
every chunk knows the state it starts in. No request is ever sorted or held in one
task, however many events it has.

A function is one number: four bits for each state before, holding the state after.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxtally.operators.sides import written
from voxtally.schemas import REQUEST_STATUSES

# Fixed values -----------------------------------------------------------------
# States that may follow each state; a request starts as NEW, and only ends end its life.
LEGAL_NEXT: dict[str, tuple[str, ...]] = {
    "NEW": ("LOCKED", "FAILED"),
    "LOCKED": ("FETCHED", "FAILED"),
    "FETCHED": ("PREPROCESSED", "PREDICTED_MODEL", "FAILED"),
    "PREPROCESSED": ("PREDICTED_MODEL", "FAILED"),
    "PREDICTED_MODEL": ("FINALIZED", "FAILED"),
    "FINALIZED": ("RESPONDED", "FAILED"),
    "RESPONDED": (),
    "FAILED": (),
}
FIRST_STATES = ("NEW",)
# ------------------------------------------------------------------------------
# Events of a chunk, which is one row of the written log.
CHUNK = 65_536


def _table(legal: Mapping[str, Sequence[str]], first: Sequence[str], states: Sequence[str]) -> np.ndarray:
    """State after, by event and state before. State 0 is that of no event yet; event 0 is unknown."""
    number = {s: i for i, s in enumerate(states, 1)}
    n = len(states) + 1
    if n > 15:
        raise ValueError("at most 14 states")
    after = np.tile(np.arange(n, dtype=np.uint8), (n, 1))
    for s in first:
        after[number[s], 0] = number[s]
    for before, nexts in legal.items():
        for s in nexts:
            after[number[s], number[before]] = number[s]
    return after


def _packed(functions: np.ndarray) -> np.ndarray:
    shifts = 4 * np.arange(functions.shape[1], dtype=np.int64)
    return (functions.astype(np.int64) << shifts).sum(axis=1)


def _scanned(functions: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What all events of a segment up to each one do together; ``first`` marks segment starts."""
    done = functions.copy()
    start = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    step = 1
    while step < len(done):
        more = np.flatnonzero(np.arange(len(done)) - step >= start)
        if not len(more):
            break
        done[more] = np.take_along_axis(done[more], done[more - step].astype(np.intp), axis=1)
        step *= 2
    return done


def _chunker(after: np.ndarray, kind: pa.DataType, size: int):
    """Chunks of a partition ordered by (request, time, event)."""

    def chunked(rows: pa.Table, number: int) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        keys = rows.column("key").combine_chunks()
        codes = np.asarray(rows.column("code")).astype(np.uint8)
        starts = np.r_[True, np.asarray(pc.not_equal(keys[1:], keys[:-1]))]
        done = _scanned(after[codes], starts)
        begins = np.flatnonzero(starts)
        ends = np.r_[begins[1:], len(codes)] - 1
        whole = _packed(done[ends])
        return pa.RecordBatch.from_arrays(
            [
                pa.array([TaskContext.get().partitionId() << 32 | number], pa.int64()),
                pa.array([keys.take(pa.array(begins)).to_pylist()], pa.list_(kind)),
                pa.array([whole.tolist()], pa.list_(pa.int64())),
                pa.array([begins.tolist()], pa.list_(pa.int64())),
                pa.array([codes.tobytes()], pa.binary()),
                pa.array([rows.column("event").to_pylist()], pa.list_(rows.schema.field("event").type)),
            ],
            ["chunk", "keys", "functions", "begins", "codes", "events"],
        )

    def cut(batches):
        held, waiting, number = [], 0, 0
        for batch in batches:
            while waiting + batch.num_rows >= size:
                take = size - waiting
                yield chunked(pa.Table.from_batches([*held, batch.slice(0, take)]), number)
                held, waiting, number, batch = [], 0, number + 1, batch.slice(take)
            if batch.num_rows:
                held.append(batch)
                waiting += batch.num_rows
        if held:
            yield chunked(pa.Table.from_batches(held), number)

    return cut


def _composed(first: Column | str, then: Column | str, n: int) -> str:
    """SQL for the function that does ``first`` and then ``then``."""
    at = lambda f, s: f"(shiftrightunsigned({f}, cast({s} as int)) & 15L)"
    parts = (f"shiftleft({at(then, f'4 * {at(first, 4 * s)}')}, {4 * s})" for s in range(n))
    return " | ".join(parts)


def _upto(parts: DataFrame, n: int) -> DataFrame:
    """Adds what all parts of a key up to each one do together, by doubling over their places."""
    order = Window.partitionBy("key").orderBy("chunk")
    spans = parts.withColumn("place", F.row_number().over(order)).withColumnRenamed("function", "upto")
    spans = written(spans, "spans")
    longest = spans.agg(F.max("place")).first()[0] or 0
    step = 1
    while step < longest:
        earlier = spans.select("key", (F.col("place") + step).alias("place"), F.col("upto").alias("before"))
        joined = spans.join(earlier, ["key", "place"], "left")
        both = F.when(F.col("before").isNotNull(), F.expr(_composed("before", "upto", n))).otherwise(F.col("upto"))
        spans = written(joined.select("key", "chunk", "place", both.alias("upto")), "spans")
        step *= 2
    return spans


class LifeCycle:
    """Event logs checked against a legal order: :meth:`violations` and :meth:`states`.

    ``events`` has one row per life-cycle event, with a time and a unique event number that
    give the order. Rows without a request are left out. A state that is not listed, or
    NULL, is never legal and changes nothing; staying in a state is always legal. The log
    is written once, in order; both results read that.
    """

    def __init__(
        self,
        events: DataFrame,
        key: str = "req_id",
        status: str = "status",
        time: str = "ts",
        event: str = "event_id",
        legal: Mapping[str, Sequence[str]] = LEGAL_NEXT,
        first: Sequence[str] = FIRST_STATES,
        states: Sequence[str] = REQUEST_STATUSES,
        chunk: int = CHUNK,
    ):
        self.names = ["", *states]
        self.after = _table(legal, first, states)
        self.n = len(self.names)
        self.key, self.event = key, event
        code = F.coalesce(F.array_position(F.array(*map(F.lit, states)), F.col(status)), F.lit(0))
        rows = events.filter(F.col(key).isNotNull()).select(
            F.col(key).alias("key"), F.col(time).alias("at"), F.col(event).alias("event"), code.cast("int").alias("code")
        )
        ordered = rows.repartitionByRange("key", "at", "event").sortWithinPartitions("key", "at", "event")
        keys, numbers = (events.schema[c].dataType.simpleString() for c in (key, event))
        kind = pa.string() if keys == "string" else pa.int64()
        narrow = ordered.select(F.col("key").cast("string" if keys == "string" else "long").alias("key"), "event", "code")
        self.key_type = keys
        self.log = written(
            narrow.mapInArrow(
                _chunker(self.after, kind, chunk),
                f"chunk long, keys array<{'string' if keys == 'string' else 'bigint'}>, functions array<bigint>,"
                f" begins array<bigint>, codes binary, events array<{numbers}>",
            ),
            "life-cycle",
        )

    def _open(self) -> DataFrame:
        """First and last request of every chunk, with what the chunk does to each."""
        ends = F.array_distinct(F.array(F.lit(0), F.size("keys") - 1))
        parts = self.log.select("chunk", "keys", "functions", F.explode(ends).alias("i"))
        return parts.select("chunk", F.get("keys", F.col("i")).alias("key"), F.get("functions", F.col("i")).alias("function"))

    def _named(self, state: Column) -> Column:
        name = F.get(F.array(*map(F.lit, self.names)), state.cast("int"))
        return F.when(state > 0, name)

    def violations(self) -> DataFrame:
        """Rows (request, event, state_before, state_asked) of the illegal events.

        ``state_before`` is NULL for a request that has no state yet, ``state_asked`` for an
        event of no known state.
        """
        spans = _upto(self._open(), self.n)
        before = spans.select("key", "chunk", "place", "upto")
        # The state a chunk starts in is what the parts before it make of no state at all.
        earlier = before.select("key", (F.col("place") + 1).alias("place"), (F.col("upto").bitwiseAND(15)).alias("start"))
        starts = before.join(earlier, ["key", "place"]).select("chunk", F.col("key").alias("opens"), "start")
        firsts = self.log.select("chunk", F.get("keys", F.lit(0)).alias("opens")).join(starts, ["chunk", "opens"])
        work = self.log.join(firsts.select("chunk", "start"), "chunk", "left")
        work = work.select("keys", "begins", "codes", "events", F.coalesce("start", F.lit(0)).cast("int").alias("start"))
        numbers = self.log.schema["events"].dataType.elementType.simpleString()
        keys = self.log.schema["keys"].dataType.elementType.simpleString()
        found = work.mapInArrow(_judge(self.after), f"key {keys}, event {numbers}, before int, asked int")
        return found.select(
            F.col("key").cast(self.key_type).alias(self.key),
            F.col("event").alias(self.event),
            self._named(F.col("before")).alias("state_before"),
            self._named(F.col("asked")).alias("state_asked"),
        )

    def states(self) -> DataFrame:
        """Rows (request, status): the state that the legal events lead to, NULL if there is none."""
        pairs = self.log.select(F.posexplode(F.arrays_zip("keys", "functions")).alias("i", "p"), F.size("keys").alias("n"))
        # What stands between the first and the last request of a chunk stands nowhere else.
        inner = pairs.filter("i > 0 and i < n - 1").select(F.col("p.keys").alias("key"), F.col("p.functions").alias("upto"))
        spans = _upto(self._open(), self.n)
        last = spans.groupBy("key").agg(F.max_by("upto", "place").alias("upto"))
        state = F.col("upto").bitwiseAND(15)
        return inner.union(last).select(
            F.col("key").cast(self.key_type).alias(self.key), self._named(state).alias("status")
        )


def _judge(after: np.ndarray):
    """Illegal events of whole chunks, each of which knows the state it starts in."""

    def judge(batches):
        for batch in batches:
            for row in batch.to_pylist():
                codes = np.frombuffer(row["codes"], np.uint8)
                begins = np.array(row["begins"], np.int64)
                starts = np.zeros(len(codes), bool)
                starts[begins] = True
                done = _scanned(after[codes], starts)
                # The first request starts in the given state, all others in none.
                part = np.searchsorted(begins, np.arange(len(codes)), "right") - 1
                entry = np.where(part == 0, row["start"], 0)
                now = done[np.arange(len(codes)), entry]
                before = np.r_[0, now[:-1]]
                before = np.where(starts, entry, before)
                bad = np.flatnonzero((now != codes) | (codes == 0))
                keys = row["keys"]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([keys[p] for p in part[bad].tolist()], batch.schema.field("keys").type.value_type),
                        pa.array([row["events"][i] for i in bad.tolist()], batch.schema.field("events").type.value_type),
                        pa.array(before[bad].astype(np.int32)),
                        pa.array(codes[bad].astype(np.int32)),
                    ],
                    ["key", "event", "before", "asked"],
                )

    return judge
