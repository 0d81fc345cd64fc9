"""Late and out-of-order events.

Figures per period of event time, corrected by every late record until a cut-off. Records are
deduplicated by key (their first arrival counts), hashed by that key into shards and, inside a shard,
read in order of arrival. Each shard keeps a finger B-tree of partial sums keyed by event-time minute:
an insert updates the ancestors of one leaf and tells whether it fell into a period already published,
and when a period's cut-off passes, its subtrees are evicted in bulk and refuse what comes later.
Periods are found and summed by descents, so closing one costs the logarithm of the window. Since the clock is the arrival of the record at hand, shards
need not know of each other, and the sums of their figures are exact. What a shard keeps in memory is
the open window, bounded by its minutes and not by the rows.

Edge cases: records without event time or arrival enter no period; repeated deliveries count once;
records from a clock that runs ahead wait in the tree for their own period; a record is late if it
arrives at or after the end of its period and counts up to and including the cut-off; an empty table
gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lavra.operators.finger_tree import LATE, REFUSED, FingerTree

_S = 1_000_000


@dataclass(frozen=True)
class Lateness:
    period_s: int = 86_400  # periods begin at multiples of this since 1970 (UTC)
    cutoff_s: int = 72 * 3600  # after the end of the period, included
    leaf_s: int = 60  # resolution of the tree's keys; divides period_s


def first_arrivals(df: DataFrame, key: str, event_us: Column, arrival_us: Column, amount: Column) -> DataFrame:
    """k, ev, ar, amount: one row per key with its first arrival. Partial sums run before the shuffle."""
    rows = df.select(F.col(key).alias("k"), event_us.alias("ev"), arrival_us.alias("ar"), amount.cast("bigint").alias("amount"))
    return (
        rows.where("k is not null and ev is not null and ar is not null")
        .groupBy("k")
        .agg(F.min(F.struct("ar", "ev", "amount")).alias("x"))
        .select("k", "x.ev", "x.ar", "x.amount")
    )


def _epochs(ar: np.ndarray, p: int, cut: int) -> Iterator[tuple[int, int]]:
    """Runs of records (sorted by arrival) within which no period closes or is evicted."""
    state = np.stack([ar // p, (ar - cut - 1) // p])
    change = np.flatnonzero(np.any(np.diff(state) != 0, axis=0)) + 1
    edges = [0, *change.tolist(), len(ar)]
    return zip(edges[:-1], edges[1:])


class Shard:
    """The tree of one shard, and what has been published of its open periods.

    Figures are given out as changes (p, em, n, amount, late, dropped): period p, as published at the end
    of period em. A period's first row has em = p; later ones are corrections by the records that arrived
    in em. Their sums are the figures after all corrections.
    """

    def __init__(self, rule: Lateness):
        self.p, self.cut, self.leaf = rule.period_s * _S, rule.cutoff_s * _S, rule.leaf_s * _S
        self.per = rule.period_s // rule.leaf_s
        self.tree = FingerTree(3)  # records, amount, late records
        self.given: dict[int, list] = {}  # sums as last published, of the periods that have ended and are not evicted
        self.closed: int | None = None  # periods below it have ended
        self.dropped: dict[int, int] = {}

    def _periods(self, low: int, high: int | None = None) -> Iterator[int]:
        """Periods from low to below high that hold records, each found by one descent."""
        k = self.tree.next_key(low * self.per)
        while k is not None and (high is None or k < high * self.per):
            d = k // self.per
            yield d
            k = self.tree.next_key((d + 1) * self.per)

    def _publish(self, d: int, em: int) -> Iterator[tuple]:
        now, was = self.tree.total(d * self.per, (d + 1) * self.per), self.given.get(d, [0, 0, 0])
        if now != was:
            yield (d, em, *[x - y for x, y in zip(now, was)], 0)
            self.given[d] = now

    def corrections(self) -> Iterator[tuple]:
        """What has changed since it was last published, in the periods that have ended."""
        if self.closed is not None:
            for d in list(self._periods(self.tree.low // self.per, self.closed)):
                yield from self._publish(d, self.closed)
        for d, n in sorted(self.dropped.items()):
            yield (d, self.closed, 0, 0, 0, n)
        self.dropped.clear()

    def _advance(self, closed: int, evict: int) -> Iterator[tuple]:
        """closed: periods below it have ended; evict: periods below it are past their cut-off."""
        if self.closed is None:
            self.closed = closed
        else:
            yield from self.corrections()
            for d in list(self._periods(self.closed, closed)):
                yield from self._publish(d, d)
        self.closed = max(self.closed, closed)
        self.tree.publish(self.closed * self.per)
        self.tree.evict(evict * self.per)
        for d in [d for d in self.given if d < evict]:
            del self.given[d]

    def take(self, ev: np.ndarray, ar: np.ndarray, amount: np.ndarray) -> tuple[np.ndarray, list[tuple]]:
        """Insert records in order of arrival. Gives which of them the tree took late, and the changes published."""
        late_taken = np.zeros(len(ev), bool)
        out: list[tuple] = []
        for a, b in _epochs(ar, self.p, self.cut):
            # a period d has ended when ar >= (d + 1) p, and is past its cut-off when ar > (d + 1) p + cut
            out += self._advance(int(ar[a] // self.p), int((ar[a] - self.cut - 1) // self.p))
            keys, where = np.unique(ev[a:b] // self.leaf, return_inverse=True)
            n, s = np.bincount(where), np.bincount(where, weights=amount[a:b])
            # the tree decides: its bounds stand still within an epoch, so all records of a leaf fare alike
            place = np.array([self._insert(k, x, int(y)) for k, x, y in zip(keys.tolist(), n.tolist(), s.tolist())])
            late_taken[a:b] = place[where] == LATE
        return late_taken, out

    def _insert(self, key: int, n: int, amount: int) -> int:
        late = n if key < self.tree.published else 0
        place = self.tree.add(key, (n, amount, late))
        if place == REFUSED:
            self.dropped[key // self.per] = self.dropped.get(key // self.per, 0) + n
        return place

    def finish(self) -> list[tuple]:
        """What is left when no more records come: the open corrections, then the periods that have not ended."""
        out = list(self.corrections())
        if self.closed is not None:
            for d in list(self._periods(self.closed)):
                out += self._publish(d, d)
        return out


def _late_rows(rule: Lateness):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = Shard(rule)
        for pdf in batches:
            late, _ = shard.take(pdf["ev"].to_numpy(), pdf["ar"].to_numpy(), pdf["amount"].fillna(0).to_numpy())
            if late.any():
                hit = pdf.loc[late]
                yield pd.DataFrame({"p": hit["ev"].to_numpy() // (rule.period_s * _S), "k": hit["k"].to_numpy(), "ev": hit["ev"].to_numpy(), "ar": hit["ar"].to_numpy()})

    return run


_CHANGE = ["p", "em", "n", "amount", "late", "dropped"]
_CHANGES = ", ".join(f"{c} bigint" for c in _CHANGE)


def _changes(rule: Lateness):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard = Shard(rule)
        for pdf in batches:
            yield pd.DataFrame(shard.take(pdf["ev"].to_numpy(), pdf["ar"].to_numpy(), pdf["amount"].fillna(0).to_numpy())[1], columns=_CHANGE)
        yield pd.DataFrame(shard.finish(), columns=_CHANGE)

    return run


def late_records(firsts: DataFrame, rule: Lateness = Lateness()) -> DataFrame:
    """p (period number), k, ev, ar: the records that the tree took late."""
    return firsts.sortWithinPartitions("ar", "k").mapInPandas(_late_rows(rule), "p bigint, k string, ev bigint, ar bigint")


def changes(firsts: DataFrame, rule: Lateness = Lateness()) -> DataFrame:
    """p, em, n, amount, late, dropped: each period as published at its end (em = p), and its corrections at the end of each later period em."""
    parts = firsts.select("k", "ev", "ar", "amount").sortWithinPartitions("ar", "k").mapInPandas(_changes(rule), _CHANGES)
    return parts.groupBy("p", "em").agg(*[F.sum(c).alias(c) for c in _CHANGE[2:]])


def corrected_figures(firsts: DataFrame, rule: Lateness = Lateness()) -> DataFrame:
    """p, first (as published at the end of the period), n and amount (corrected), late, dropped, per period: the sums of its changes."""
    parts = firsts.select("k", "ev", "ar", "amount").sortWithinPartitions("ar", "k").mapInPandas(_changes(rule), _CHANGES)
    return parts.groupBy("p").agg(F.sum(F.col("n") - F.col("late")).alias("first"), *[F.sum(c).alias(c) for c in _CHANGE[2:]])


def stream_changes(records: DataFrame, rule: Lateness = Lateness(), shards: int = 64, repeats: str = "10 days") -> DataFrame:
    """The same changes from a stream of k, ev, ar (microseconds), amount; append mode.

    The state of a shard is its tree, kept between batches and runs; each batch inserts its records in
    order of arrival and gives out the changes of the periods that have ended. Keys delivered again within
    `repeats` count once. Sums over all rows of a period are its figures so far.
    """
    firsts = (
        records.where("k is not null and ev is not null and ar is not null")
        .withColumn("em", F.timestamp_micros("ar")).withWatermark("em", repeats).dropDuplicatesWithinWatermark(["k"])
        .select(F.pmod(F.xxhash64("k"), F.lit(shards)).alias("shard"), "ev", "ar", F.coalesce("amount", F.lit(0)).cast("bigint").alias("amount"))
    )

    def advance(_key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        shard = pickle.loads(state.get[0]) if state.exists else Shard(rule)
        new = pd.concat(list(batches)).sort_values("ar", kind="stable")
        out = shard.take(new["ev"].to_numpy(), new["ar"].to_numpy(), new["amount"].to_numpy())[1]
        out += shard.corrections()
        state.update((pickle.dumps(shard),))
        yield pd.DataFrame(out, columns=_CHANGE)

    return firsts.groupBy("shard").applyInPandasWithState(advance, _CHANGES, "tree binary", "append", "NoTimeout")
