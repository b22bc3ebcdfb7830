"""Adaptive windowing (ADWIN) on a stream of values a key, and its batch twin, with state that grows with the logarithm of the window.

A value is appended to the key's window; from `least` values on the cuts into an older and a newer part are tested from the oldest on, and at the
first whose means differ by epsilon = sqrt((1 / 2n0 + 1 / 2n1) ln(4n / delta)) or more the older part goes (the newest value is
never a part of its own).

The newest `exact` values are held one by one. Older ones are held in an exponential histogram: buckets of 1, 2, 4, ... values (their
number and sum), at most `each` of a size; of more, the two oldest become one of the next size. So a window of n values takes
exact + each * log2(n / each) numbers, and as many operations a value. Windows of up to `exact` values are tested at every cut, as the
plain loop does. Beyond, only cuts between buckets are tested: the mean on either side of any is exact, and of the other cuts each is
within n0 / each values of a tested one (n0: the values before it), so a change is found at a cut that is late or early by at most that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, IntegerType, LongType, StructField, StructType

LEAST = 32


class AdaptiveWindow:
    """counts and sums of the buckets, from the oldest on, and the newest values."""

    def __init__(self, delta: float = 0.002, exact: int = 512, each: int = 32, least: int = LEAST, counts: list[int] | None = None, sums: list[float] | None = None, newest: list[float] | None = None):
        self.delta, self.exact, self.each, self.least = delta, exact, each, least
        self.counts, self.sums, self.newest = counts or [], sums or [], newest or []

    def __len__(self) -> int:
        return sum(self.counts) + len(self.newest)

    def _settle(self) -> None:
        """Moves the oldest single value into the buckets and joins buckets of a size that has too many."""
        self.counts.append(1)
        self.sums.append(self.newest.pop(0))
        size, end = 1, len(self.counts)
        while True:
            start = end
            while start and self.counts[start - 1] == size:
                start -= 1
            if end - start <= self.each:
                return
            self.counts[start : start + 2] = [2 * size]
            self.sums[start : start + 2] = [self.sums[start] + self.sums[start + 1]]
            size, end = 2 * size, start + 1

    def update(self, value: float) -> bool:
        """Whether drift was found with this value; the older part has gone then."""
        self.newest.append(float(value))
        if len(self.newest) > self.exact:
            self._settle()
        n = len(self)
        if n < self.least:
            return False
        left = np.cumsum(np.concatenate([np.array(self.counts, np.int64), np.ones(len(self.newest), np.int64)]))[:-2]
        sums = np.cumsum(np.concatenate([np.array(self.sums, float), self.newest]))
        gap = np.abs(sums[:-2] / left - (sums[-1] - sums[:-2]) / (n - left))
        hit = np.flatnonzero(gap >= np.sqrt((1 / (2 * left) + 1 / (2 * (n - left))) * np.log(4 * n / self.delta)))
        if not len(hit):
            return False
        gone = int(hit[0]) + 1
        buckets = min(gone, len(self.counts))
        del self.counts[:buckets], self.sums[:buckets], self.newest[: gone - buckets]
        return True


def detected(df: DataFrame, key: str, time: str, value: str, delta: float = 0.002, exact: int = 512, each: int = 32) -> DataFrame:
    """Batch twin: key, time and window size of every drift. A key's values go by in order, batch by batch, and are never held together."""
    schema = df.select(key, time).schema.add("window_size", IntegerType())

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, window = None, None
        for b in batches:
            out = []
            for k, t, v in zip(b[key], b[time], b[value]):
                if window is None or k != current:
                    current, window = k, AdaptiveWindow(delta, exact, each)
                if window.update(v):
                    out.append((k, t, len(window)))
            yield pd.DataFrame(out, columns=[key, time, "window_size"])

    rows = df.select(key, time, value).where(f"`{key}` IS NOT NULL AND `{value}` IS NOT NULL")
    return rows.repartition(key).sortWithinPartitions(key, time, value).mapInPandas(run, schema)


class _Detector(StatefulProcessor):
    """A key's buckets and newest values in list states, which expire when the key has been silent for `silent_ms` (None: never)."""

    def __init__(self, key: str, time: str, value: str, delta: float, exact: int, each: int, silent_ms: int | None):
        self.columns, self.sizes, self.silent_ms = (key, time, value), (delta, exact, each), silent_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.buckets = handle.getListState("buckets", StructType([StructField("n", LongType()), StructField("total", DoubleType())]), self.silent_ms)
        self.newest = handle.getListState("newest", StructType([StructField("value", DoubleType())]), self.silent_ms)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803 - the API's names
        name, time, value = self.columns
        held = list(self.buckets.get())
        window = AdaptiveWindow(*self.sizes, counts=[n for n, _ in held], sums=[s for _, s in held], newest=[v for (v,) in self.newest.get()])
        batch, out = pd.concat(list(rows)).sort_values([time, value]), []
        for t, v in zip(batch[time], batch[value]):
            if window.update(v):
                out.append((key[0], t, len(window)))
        for state, now in ((self.buckets, list(zip(window.counts, window.sums))), (self.newest, [(v,) for v in window.newest])):
            state.put(now) if now else state.clear()
        yield pd.DataFrame(out, columns=[name, time, "window_size"])

    def close(self) -> None:
        pass


def streamed(df: DataFrame, key: str, time: str, value: str, delta: float = 0.002, exact: int = 512, each: int = 32, silent_ms: int | None = None) -> DataFrame:
    """The same on a stream; a micro-batch is taken in the order of its time column. Needs the RocksDB state store
    (spark.sql.streaming.stateStore.providerClass); state and progress are in the query's checkpoint, so it goes on after a restart."""
    schema = df.select(key, time).schema.add("window_size", IntegerType())
    rows = df.select(key, time, value).where(f"`{key}` IS NOT NULL AND `{value}` IS NOT NULL")
    mode = "ProcessingTime" if silent_ms else "None"
    return rows.groupBy(key).transformWithStateInPandas(_Detector(key, time, value, delta, exact, each, silent_ms), schema, "Append", mode)
