"""The history of changing attributes, from presence bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidemark.session import cut_lineage

#: Snapshots per bitmap word: few enough that the sum below stays inside a long.
WORD = 60
FULL = (1 << WORD) - 1


def _hash(rows: DataFrame, attributes: Column) -> Column:
    """Hash of a value, a struct's fields each with a null mark: the hash itself passes over nulls, whatever field they are in."""
    whole = rows.select(attributes.alias("a")).schema["a"].dataType
    fields = [attributes.getField(f) for f in whole.names] if isinstance(whole, StructType) else [attributes]
    return F.xxhash64(attributes.isNull(), *(c for f in fields for c in (f.isNull(), f)))


def bitmap_history(rows: DataFrame, *, entity: list[str], snapshot: str, attributes: Column, key: str, start: str) -> DataFrame:
    """Validity intervals of an entity's attribute values over its numbered snapshots.

    For each entity and attribute hash one bit is set per snapshot number, in words of 60.
    Within a word an entity's runs of consecutive bits - consecutive among the snapshots
    the entity has, so gaps in the numbering end nothing - become versions; a word's first
    run that goes on with the value the word before ended with is no new version.
    A version is valid from the start of its first snapshot to the start of the next
    version of the entity.

    Result: the entity, ``version_key`` (``key`` of the first snapshot), ``valid_from``,
    ``valid_to`` (null if open), ``versions`` (how many the entity has).
    One snapshot of an entity is reduced to one row before anything is gathered, so a word
    holds at most 60 entries, whatever share of the rows an entity has; the words of an
    entity, at most a 60th of its snapshots, are ordered to pass on what they end with.
    Defined cases: a null snapshot number or start is left out; of several rows with one
    snapshot number the greatest by start, then key, stands; null attributes are a value;
    extra columns are ignored.
    """
    e = [f"e{i}" for i in range(len(entity))]
    narrow = rows.select(*(F.col(c).alias(n) for c, n in zip(entity, e, strict=True)), F.col(snapshot).cast("long").alias("no"), _hash(rows, attributes).alias("hash"), F.col(start).alias("start"), F.col(key).alias("key")).where("no IS NOT NULL AND start IS NOT NULL")
    single = narrow.groupBy(*e, "no").agg(F.max(F.struct("start", "key", "hash")).alias("r")).select(*e, F.expr(f"cast(floor(no / {WORD}) AS long)").alias("word"), F.expr(f"cast(pmod(no, {WORD}) AS int)").alias("bit"), "r.*")
    # bitmaps: per entity, word and hash one long; the marks give back key and start of a bit
    bits = (
        single.repartition(*e, "word").groupBy(*e, "word", "hash")
        .agg(F.bit_or(F.expr("shiftleft(1L, bit)")).alias("bits"), F.collect_list(F.struct("bit", "start", "key")).alias("marks"))
    )
    words = bits.groupBy(*e, "word").agg(F.bit_or("bits").alias("mask"), F.collect_list(F.struct("hash", "bits", "marks")).alias("maps"))
    # adding a hash's bits, moved on by one, to the gaps of the mask carries each bit through
    # the gap above it to the next snapshot there is: those bits of the hash begin no run
    begins = f"(x.bits & ~((((~mask) & {FULL}L) + shiftleft(x.bits, 1)) & mask))"
    runs = F.expr(f"""
        array_sort(flatten(transform(maps, x -> transform(
            filter(x.marks, k -> (shiftright({begins}, k.bit) & 1L) = 1L),
            k -> named_struct('bit', k.bit, 'start', k.start, 'key', k.key, 'hash', x.hash)))))
    """)
    # the bitmaps of a word are disjoint: the greatest holds its last snapshot
    last_hash = F.expr("array_max(transform(maps, x -> named_struct('bits', x.bits, 'hash', x.hash))).hash")
    cut = words.select(*e, "word", runs.alias("runs"), last_hash.alias("last_hash"))
    order = Window.partitionBy(*e).orderBy("word")
    fresh = F.expr("CASE WHEN came <=> runs[0].hash AND came_word IS NOT NULL THEN slice(runs, 2, size(runs)) ELSE runs END")
    joined = cut.withColumn("came", F.lag("last_hash").over(order)).withColumn("came_word", F.lag("word").over(order)).withColumn("runs", fresh)
    onward = Window.partitionBy(*e).orderBy(F.col("word").desc()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*e)
    linked = joined.withColumn("next", F.last(F.expr("CASE WHEN size(runs) > 0 THEN runs[0].start END"), ignorenulls=True).over(onward)).withColumn("versions", F.sum(F.size("runs")).over(whole))
    flat = linked.select(*e, "versions", F.expr("inline(transform(runs, (r, i) -> named_struct('key', r.key, 'start', r.start, 'stop', CASE WHEN i + 1 < size(runs) THEN runs[i + 1].start ELSE next END)))"))
    return flat.select(*(F.col(n).alias(c) for c, n in zip(entity, e, strict=True)), F.col("key").alias("version_key"), F.col("start").alias("valid_from"), F.col("stop").alias("valid_to"), "versions")


def connected(pairs: DataFrame, *, most_rounds: int = 40) -> DataFrame:
    """The component of every node of an undirected graph: (node, root), root the least node.

    ``pairs``: a, b. Two alternating steps on the edge list: each node points its larger
    neighbours to its least one, then its smaller ones too, until nothing changes; the
    number of rounds grows with the logarithm of a component's extent. Edges stay
    distributed and are checkpointed each round. Raises if ``most_rounds`` don't do.
    """
    edges = cut_lineage(pairs.where("a IS NOT NULL AND b IS NOT NULL AND a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    nodes = edges.select(F.col("u").alias("node")).union(edges.select("v")).distinct()
    print_of = lambda df: df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    seen = print_of(edges)
    for _ in range(most_rounds if seen[0] else 0):
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u != v").distinct()
        edges = cut_lineage(small)
        now = print_of(edges)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError("components did not settle")
    return nodes.join(edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root")), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
