"""Attributes as they were known at an event's time."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import cut_lineage

#: The tick at which open versions end: past any date.
NEVER = 1 << 22

#: Ticks per shard, as a power of two, where nothing asks for fewer.
WIDEST = 9


def _cover(lo: str, hi: str, levels: str) -> str:
    """SQL: the aligned nodes (level, node) that together cover the shards lo <= s < hi."""
    spans = f"transform(sequence(0, {levels}), k -> named_struct('k', k, 'l', shiftright(({lo}) + shiftleft(1L, k) - 1, k), 'r', shiftright({hi}, k)))"
    live = f"filter({spans}, x -> x.l < x.r)"
    left = "transform(filter(live, x -> x.l & 1 = 1), x -> named_struct('level', x.k, 'node', x.l))"
    right = "transform(filter(live, x -> x.r & 1 = 1), x -> named_struct('level', x.k, 'node', x.r - 1))"
    return f"flatten(transform(array({live}), live -> concat({left}, {right})))"


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Over batches sorted by (entity, shard): the best live version after each tick that may change it.

    A heap holds the live versions, best rank first; those that have ended are dropped
    when they come up.
    """
    key: tuple | None = None
    spans: list[tuple[int, int, tuple[int, int, int]]] = []
    rows: list[tuple] = []

    def sweep() -> None:
        begin, end = key[1] << key[2], (key[1] + 1) << key[2]
        ticks = {lo for lo, _, _ in spans if lo >= begin} | {hi for _, hi, _ in spans if begin <= hi < end}
        spans.sort()
        live: list[tuple] = []
        i, best = 0, -1
        for tick in sorted(ticks):
            while i < len(spans) and spans[i][0] <= tick:
                _, hi, rank = spans[i]
                heapq.heappush(live, (-rank[0], -rank[1], -rank[2], hi))
                i += 1
            while live and live[0][3] <= tick:
                heapq.heappop(live)
            now = -live[0][2] if live else None
            if now != best:
                rows.append((key[0], key[1], tick, now))
                best = now

    def flush() -> Iterator[pa.RecordBatch]:
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.int64(), pa.int64()), strict=True)], ["entity", "shard", "tick", "version"])
            rows.clear()

    for batch in batches:
        for entity, shard, bits, lo, hi, first, second, version in zip(*(batch.column(i).to_pylist() for i in range(8)), strict=True):
            if key is None or key[:2] != (entity, shard):
                if key:
                    sweep()
                key = (entity, shard, bits)
                spans.clear()
            spans.append((lo, hi, (first, second, version)))
        yield from flush()
    if key:
        sweep()
    yield from flush()


def best_version_changes(versions: DataFrame) -> DataFrame:
    """The moments at which an entity's best live version changes.

    ``versions``: entity (text), bits, lo, hi (ticks; live while lo <= tick < hi), rank_1,
    rank_2 and version (whole numbers; of the live versions the one greatest by rank_1,
    rank_2, version is best). An entity's time line is cut into shards of 2**``bits`` ticks (one
    number for each entity), each swept by itself: a version is sent to the shards where it
    begins and ends; of those that live through a whole shard only the best matters, found
    from aligned covers (the best of those with the same shards gives a few nodes, each node
    keeps its best, combined before the shuffle).
    """
    levels = f"{NEVER.bit_length()} - bits"  # as many as the shards up to NEVER have
    v = versions.select("entity", "bits", "lo", "hi", F.struct("rank_1", "rank_2", "version").alias("rank"), F.expr("shiftright(lo, bits)").alias("first"), F.expr(f"CASE WHEN hi < {NEVER} THEN shiftright(hi, bits) END").alias("final"))
    ends = v.select("entity", "bits", F.explode(F.array_distinct(F.array_compact(F.array("first", "final")))).alias("shard"), "lo", "hi", "rank")
    # of the versions that live through the same shards only the best matters: few are left to be spread over nodes
    lasting = v.withColumn("final", F.coalesce("final", F.expr(f"shiftright({NEVER}L, bits)"))).where("final > first + 1").groupBy("entity", "bits", "first", "final").agg(F.max("rank").alias("rank"))
    nodes = lasting.select("entity", "rank", F.explode(F.expr(_cover("first + 1", "final", levels))).alias("n")).groupBy("entity", "n.level", "n.node").agg(F.max("rank").alias("rank"))
    shards = ends.select("entity", "bits", "shard").distinct()
    above = shards.select("entity", "bits", "shard", F.explode(F.expr(f"transform(sequence(0, {levels}), k -> named_struct('level', k, 'node', shiftright(shard, k)))")).alias("n")).select("entity", "bits", "shard", "n.level", "n.node")
    carried = above.join(nodes, ["entity", "level", "node"]).groupBy("entity", "bits", "shard").agg(F.max("rank").alias("rank"))
    through = carried.select("entity", "bits", "shard", (F.expr("shiftleft(shard, bits)") - 1).alias("lo"), F.lit(NEVER).cast("long").alias("hi"), "rank")
    # one tick before the shard: it was there already, so its coming is no change here
    flat = ends.unionByName(through).select("entity", "shard", "bits", F.col("lo").cast("long").alias("lo"), F.col("hi").cast("long").alias("hi"), *(F.col(f"rank.{c}").cast("long").alias(c) for c in ("rank_1", "rank_2", "version")))
    ordered = flat.repartition("entity", "shard").sortWithinPartitions("entity", "shard")
    return ordered.mapInArrow(_sweep, "entity string, shard long, tick long, version long")


def number_events(changes: DataFrame, events: DataFrame, *, slice_rows: int = 200_000) -> tuple[DataFrame, DataFrame]:
    """Number versions and events by the cumulative count of changes in their entity.

    ``changes``: entity, shard, tick, version; ``events``: entity, shard, tick, id. Narrow rows of
    both are put together and counted per entity and shard in time order; a shard begins
    where the running total of the shards before it ends. The events of a shard with more
    than ``slice_rows`` of them are dealt out by a hash of the id to as many slices as that
    takes, each with its own copy of the shard's changes.
    Returns (entity, number, version) and (entity, number, id).
    """
    totals = changes.groupBy("entity", "shard").agg(F.count(F.lit(1)).alias("changes"))
    asked = events.groupBy("entity", "shard").agg(F.count(F.lit(1)).alias("events"))
    before = Window.partitionBy("entity").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    both = totals.join(asked, ["entity", "shard"], "full")
    shards = cut_lineage(both.select("entity", "shard", F.coalesce(F.sum("changes").over(before), F.lit(0)).alias("offset"), F.greatest(F.lit(1), F.ceil(F.coalesce("events", F.lit(0)) / slice_rows)).cast("int").alias("slices")))
    inside = Window.partitionBy("entity", "shard").orderBy("tick")
    numbered = changes.withColumn("k", F.row_number().over(inside)).join(shards.select("entity", "shard", "offset"), ["entity", "shard"]).select("entity", (F.col("offset") + F.col("k")).alias("number"), "version")
    kind = events.schema["id"].dataType
    # a shard without changes has the number before it, a shard without events asks nothing
    hot = shards.where("slices > 1").select("entity", "shard", "slices")
    placed = lambda df, slice_: df.join(hot, ["entity", "shard"], "left").withColumn("slice", slice_)
    marks = placed(changes, F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1))).select("entity", "shard", "slice", "tick", F.lit(1).alias("change"), F.lit(None).cast(kind).alias("id"))
    asks = placed(events, F.coalesce(F.pmod(F.xxhash64("id"), F.col("slices")), F.lit(0)).cast("int")).select("entity", "shard", "slice", "tick", F.lit(0).alias("change"), "id")
    local = Window.partitionBy("entity", "shard", "slice").orderBy("tick", F.col("change").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    counted = marks.unionByName(asks).withColumn("count", F.sum("change").over(local)).where("change = 0")
    return numbered, counted.join(shards.select("entity", "shard", "offset"), ["entity", "shard"]).select("entity", (F.col("offset") + F.col("count")).alias("number"), "id")


def dense_entities(versions: DataFrame, shard_rows: int) -> DataFrame:
    """(entity, bits) of those whose fullest shard of 2**``WIDEST`` ticks holds more than ``shard_rows`` versions: the power for about that many.

    Counts are combined before the shuffle; each entity has its own, a dense one makes no other narrow.
    """
    fullest = versions.groupBy("entity", F.expr(f"shiftright(lo, {WIDEST})").alias("s")).agg(F.count(F.lit(1)).alias("n")).groupBy("entity").agg(F.max("n").alias("n"))
    return fullest.where(F.col("n") > shard_rows).select("entity", F.greatest(F.lit(0), WIDEST - F.ceil(F.log2(F.col("n") / shard_rows))).cast("int").alias("bits"))


def known_at(events: DataFrame, versions: DataFrame, *, wide: DataFrame | None = None, width: int | None = None, shard_rows: int = 100_000, slice_rows: int = 200_000) -> DataFrame:
    """Each event with the version of its entity that was known, and best, at its time.

    ``events``: entity, tick, id; ``versions``: entity, lo, hi, rank_1, rank_2, version (see
    :func:`best_version_changes`); ``wide``: further attributes keyed by ``version``, joined to
    the numbered versions first and so carried once per version. Events get their version's
    number and are equi-joined on entity and number. Nothing that began later than an event
    or had ended is ever seen. Without ``width`` (a power of two) an entity's time is cut so
    that no shard holds much more than ``shard_rows`` of its versions (:func:`dense_entities`);
    events of one shard are dealt out beyond ``slice_rows`` (:func:`number_events`). A number
    that very many events share is left to the engine's splitting of skewed joins.

    Defined cases: events or versions with a null entity or tick are left out; versions
    with a null hi never end; empty periods (hi <= lo) never live; events without a live
    version give no row; repeated events give one row each, repeated versions count once; an
    attribute named entity, number or id gets ``_attribute`` behind its name.
    """
    whole = lambda c: F.col(c).cast("long").alias(c)
    v = versions.where("entity IS NOT NULL AND lo IS NOT NULL AND version IS NOT NULL").select("entity", whole("lo"), F.coalesce("hi", F.lit(NEVER)).cast("long").alias("hi"), *(whole(c) for c in ("rank_1", "rank_2", "version"))).where("hi > lo")
    asks = events.where("entity IS NOT NULL AND tick IS NOT NULL").select("entity", whole("tick"), "id")
    # narrow rows that are read several times below: checkpointed, so that nothing is parsed or swept twice and a lost executor costs no second time
    v, asks = cut_lineage(v), cut_lineage(asks)
    if width:
        bits = lambda df: df.withColumn("bits", F.lit(width.bit_length() - 1))
    else:
        dense = cut_lineage(dense_entities(v, shard_rows))
        bits = lambda df: df.join(dense, "entity", "left").withColumn("bits", F.coalesce("bits", F.lit(WIDEST)))
    changes = cut_lineage(best_version_changes(bits(v)))
    numbered, asked = number_events(changes, bits(asks).select("entity", F.expr("shiftright(tick, bits)").alias("shard"), "tick", "id"), slice_rows=slice_rows)
    attributes = numbered.where("version IS NOT NULL")
    if wide is not None:
        clear = {c: f"{c}_attribute" for c in wide.columns if c in ("entity", "number", "id")}
        attributes = attributes.join(wide.withColumnsRenamed(clear).dropDuplicates(["version"]), "version")
    return asked.join(attributes, ["entity", "number"])
