"""Combining items of varying length into containers of fixed capacity."""

from __future__ import annotations

import bisect
from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def optimal_buckets(histogram: dict[int, int], capacity: int, most: int) -> list[int]:
    """Upper bounds of at most ``most`` length buckets with the least unused space.

    An item of a bucket counts with the bucket's bound; a container takes as many as fit.
    Dynamic programming over the histogram: best[k][i] is the least number of containers
    for the i shortest lengths in k buckets.
    """
    lengths = sorted(n for n in histogram if 0 < n <= capacity)
    m = len(lengths)
    if not m:
        return []
    below = np.concatenate([[0], np.cumsum([histogram[n] for n in lengths])]).astype(float)
    best = np.full(m + 1, np.inf)
    best[0] = 0
    choice: list[np.ndarray] = []
    for _ in range(min(most, m)):
        now, came = best.copy(), np.full(m + 1, -1)
        for i in range(1, m + 1):
            costs = best[:i] + (below[i] - below[:i]) / (capacity // lengths[i - 1])
            j = int(np.argmin(costs))
            if costs[j] < now[i] - 1e-9:
                now[i], came[i] = costs[j], j
        if choice and now[m] >= best[m]:
            break
        choice.append(came)
        best = now
    bounds, i, k = [], m, len(choice) - 1
    while i:
        while choice[k][i] < 0:
            k -= 1
        bounds.append(lengths[i - 1])
        i, k = int(choice[k][i]), k - 1
    return bounds[::-1]


def fill_plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """How the items of each length go into containers: (length, from_rank, to_rank, container, times, offset).

    Containers are planned by kind, longest items first, each filled up with the longest
    lengths that still fit; a kind is used as often as its lengths last, so every kind
    uses up a length and there are at most ``capacity`` kinds. Ranks from_rank <= r <
    to_rank of a length, ``times`` of them to a container, go to consecutive containers
    from ``container`` on, ``offset`` being the place of the first.
    """
    left = {n: c for n, c in histogram.items() if 0 < n <= capacity and c}
    lengths = sorted(left)
    used = dict.fromkeys(left, 0)
    plan, container = [], 0
    while lengths:
        kind: list[tuple[int, int, int]] = []  # length, times, offset
        space, offset = capacity, 0
        at = len(lengths)
        while space:
            at = min(bisect.bisect_right(lengths, space), at) - 1
            if at < 0:
                break
            n = lengths[at]
            times = min(space // n, left[n])
            kind.append((n, times, offset))
            space -= n * times
            offset += n * times
        repeat = min(left[n] // times for n, times, _ in kind)
        for n, times, place in kind:
            taken = repeat * times
            plan.append((n, used[n], used[n] + taken, container, times, place))
            used[n] += taken
            left[n] -= taken
            if not left[n]:
                lengths.remove(n)
        container += repeat
    return plan


def items(sizes: DataFrame, *, id: str, size: str, capacity: int) -> DataFrame:  # noqa: A002
    """(id, part, length): each item, those longer than the capacity split into full parts and a rest."""
    n = F.col(size).cast("long")
    parts = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((n - 1) / capacity)))
    return sizes.where(n.isNotNull()).select(F.col(id), n.alias("n"), F.explode(parts).alias("part")).select(id, F.col("part").cast("int").alias("part"), F.least(F.lit(capacity).cast("long"), F.col("n") - F.col("part") * capacity).alias("length"))


def _ranked(pieces: DataFrame, order: Sequence[str], slices: int) -> DataFrame:
    """The pieces with a running number within their length, without gathering a length in one task."""
    sliced = pieces.withColumn("slice", F.pmod(F.xxhash64(*order), F.lit(slices)).cast("int"))
    counts = sliced.groupBy("length", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("length", "slice", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("begin"))
    local = sliced.withColumn("at", F.row_number().over(Window.partitionBy("length", "slice").orderBy(*order)) - 1)
    return local.join(offsets, ["length", "slice"]).withColumn("rank", F.col("begin") + F.col("at")).drop("slice", "at", "begin")


def _slices(histogram: dict[int, int], least: int, slice_rows: int = 500_000) -> int:
    """Slices of a length, so many that the most frequent one has about ``slice_rows`` pieces in each."""
    return max(least, -(-max(histogram.values(), default=0) // slice_rows))


def histogram_of(pieces: DataFrame) -> dict[int, int]:
    """How many pieces of each length there are; at most ``capacity`` + 1 rows come to the driver."""
    return {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}


def pack(sizes: DataFrame, *, id: str, size: str, capacity: int = 2048, slices: int = 64) -> DataFrame:  # noqa: A002
    """Items into containers with next to no unused space: (id, part, container, place, length).

    Only the histogram of lengths, at most ``capacity`` + 1 numbers, is planned on the
    driver (:func:`fill_plan`); items learn their rank within their length from counts per
    slice and find their container by the plan, whose rows are bounded by the capacity
    too. ``sizes`` should be read from storage or a checkpoint: it is used twice.

    Defined cases: an item longer than the capacity is split, every part but the last
    full, no other is; an item of size 0 or less takes no space and is in container 0; a
    null size is left out; repeated and null ids are items of their own; no items, no rows.
    """
    pieces = items(sizes, id=id, size=size, capacity=capacity)
    histogram = histogram_of(pieces)
    plan = fill_plan(histogram, capacity)
    spark = sizes.sparkSession
    ranges: dict[int, list[tuple[int, ...]]] = {}
    for n, *one in plan:
        ranges.setdefault(int(n), []).append(tuple(map(int, one)))
    rules = spark.createDataFrame(list(ranges.items()), "length long, ranges array<struct<from_rank:long,to_rank:long,container:long,times:long,offset:long>>")
    ranked = _ranked(pieces.where("length > 0"), [id, "part"], _slices(histogram, slices))
    # one row per length with its few ranges, so that an item meets one row
    placed = ranked.join(F.broadcast(rules), "length").withColumn("r", F.expr("filter(ranges, x -> rank >= x.from_rank AND rank < x.to_rank)[0]"))
    done = placed.select(id, "part", F.expr("r.container + (rank - r.from_rank) div r.times").alias("container"), F.expr("r.offset + ((rank - r.from_rank) % r.times) * length").alias("place"), "length")
    empty = pieces.where("length <= 0").select(id, "part", F.lit(0).cast("long").alias("container"), F.lit(0).cast("long").alias("place"), F.lit(0).cast("long").alias("length"))
    return done.unionByName(empty)


def bucket_batches(sizes: DataFrame, *, id: str, size: str, capacity: int = 2048, most: int = 32, slices: int = 64) -> DataFrame:  # noqa: A002
    """Padded batches of optimal length buckets: (id, part, container, place, length, bound).

    The bucket bounds come from :func:`optimal_buckets` over the global histogram; inside
    a bucket, items take places of the bucket's bound, as many to a container as fit.
    Cases as for :func:`pack`.
    """
    pieces = items(sizes, id=id, size=size, capacity=capacity)
    histogram = histogram_of(pieces)
    bounds = optimal_buckets(histogram, capacity, most)
    spark, base, rows, low = sizes.sparkSession, 0, [], 0
    for bound in bounds:
        seen = 0
        for n in sorted(x for x in histogram if low < x <= bound):
            rows.append((n, bound, seen, base, capacity // bound))
            seen += histogram[n]
        base += -(-seen // (capacity // bound))
        low = bound
    rules = spark.createDataFrame([tuple(map(int, r)) for r in rows], "length long, bound long, begin long, base long, per long")
    ranked = _ranked(pieces.where("length > 0"), [id, "part"], _slices(histogram, slices))
    placed = ranked.join(F.broadcast(rules), "length").withColumn("rank", F.col("rank") + F.col("begin"))
    return placed.select(id, "part", F.expr("base + rank div per").alias("container"), F.expr("(rank % per) * bound").alias("place"), "length", "bound")
