"""A fact store of Parquet files, partitioned for pruning, written append-only."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.ledger import row_hash
from tidemark.session import cut_lineage


def append_facts(facts: DataFrame, root: str, *, keys: list[str], observed: str = "observation_date") -> int:
    """Append the facts that the store doesn't hold yet; returns how many.

    Layout: source_id / year, files sorted by key within their partition so that row-group
    statistics prune. The same facts again write nothing; a key that comes with other content
    than the store's, or with two contents at once, raises and nothing is written. Only the
    store's partitions that the facts fall into are read.
    """
    spark = facts.sparkSession
    content = row_hash(*facts.columns)
    came = facts.withColumn("fact_hash", content).withColumn("year", F.year(observed))
    place = ["source_id", "year"]
    rest = [c for c in came.columns if c not in (*keys, "fact_hash")]
    once = came.groupBy(*keys).agg(F.min(F.struct("fact_hash", *rest)).alias("r"), (F.min("fact_hash") != F.max("fact_hash")).alias("torn")).select(*keys, "r.*", "torn")
    once = cut_lineage(once)
    judged = once.withColumn("known", F.lit(None).cast("string"))
    if _exists(spark, root):
        # the pairs of source and year that came are few: a literal filter prunes the listing
        touched = [r.asDict() for r in once.select(*place).distinct().collect()]
        where = F.lit(False)
        for year in {t["year"] for t in touched}:
            sources = [t["source_id"] for t in touched if t["year"] == year]
            here = F.col("year").isNull() if year is None else F.col("year") == year
            where = where | (here & (F.col("source_id").isin([x for x in sources if x is not None]) | (F.col("source_id").isNull() if None in sources else F.lit(False))))
        held = spark.read.option("mergeSchema", True).parquet(root).where(where).select(*(F.col(k).alias(f"_{k}") for k in keys), F.col("fact_hash").alias("_hash"))
        same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
        judged = once.join(held, same, "left").withColumn("known", F.col("_hash")).select(*once.columns, "known")
    bad = judged.where("torn OR known != fact_hash").select(*keys).limit(5).collect()
    if bad:
        raise ValueError(f"keys with other content: {[tuple(r) for r in bad]}")
    new = judged.where("known IS NULL").drop("torn", "known").repartition(*place).sortWithinPartitions(*place, *(k for k in keys if k not in place))
    n = judged.where("known IS NULL").count()
    if n:
        new.write.mode("append").partitionBy(*place).option("compression", "zstd").parquet(root)
    return n


def read_facts(spark: SparkSession, root: str, *, upto_year: int | None = None) -> DataFrame:
    """All facts; files with other columns join by name; later years aren't even listed."""
    df = spark.read.option("mergeSchema", True).parquet(root)
    return df if upto_year is None else df.where(F.col("year") <= upto_year)


def write_once(df: DataFrame, path: str) -> None:
    """Write a table that must not be there yet."""
    df.write.mode("errorifexists").parquet(path)


def rebuild(df: DataFrame, path: str) -> None:
    """Delete all that is at ``path`` and write the table anew."""
    df.write.mode("overwrite").parquet(path)


def content_hash(df: DataFrame) -> str:
    """SHA-256 over the schema and the rows, in any order: counts and sums of two hashes of each row, combined before the shuffle."""
    text = F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})
    halves = [F.sum(F.xxhash64(F.lit(salt), text).cast("decimal(38,0)")).alias(f"h{salt}") for salt in (1, 2)]
    r = df.agg(F.count(F.lit(1)).alias("n"), *halves).first()
    return hashlib.sha256(f"{df.schema.simpleString()}|{r['n']}|{r['h1']}|{r['h2']}".encode()).hexdigest()


def publish(df: DataFrame, root: str, name: str) -> str:
    """Write a table beside its older versions and make it the one that ``name`` stands for.

    A version's folder is named by its content, its pointer by the next number; a pointer is
    created, never changed, so readers find the old version or the new one, and of two
    writers each gets a number of its own. The same content as the newest writes nothing.
    """
    spark = df.sparkSession
    fs, at = _fs(spark, root)
    digest = content_hash(df)
    newest = _newest(spark, root, name)
    if newest and f"/content={digest}/" in newest:
        return newest
    target = f"{root}/{name}/content={digest}/write={uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(target)
    number = 1 + max(_pointers(spark, root, name), default=0)
    while True:
        try:
            out = fs.create(at(f"{root}/{name}.latest/{number:010d}"), False)
        except Exception as e:
            if "AlreadyExists" not in str(e) and "already exists" not in str(e):
                raise
            number += 1
            continue
        out.writeBytes(target)
        out.close()
        return target


def latest(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The version that the greatest pointer of ``name`` names."""
    newest = _newest(spark, root, name)
    if newest is None:
        raise FileNotFoundError(f"nothing published as {name} in {root}")
    return spark.read.parquet(newest)


def _pointers(spark: SparkSession, root: str, name: str) -> list[int]:
    fs, at = _fs(spark, root)
    folder = at(f"{root}/{name}.latest")
    return sorted(int(s.getPath().getName()) for s in fs.listStatus(folder) if s.getPath().getName().isdigit()) if fs.exists(folder) else []


def _newest(spark: SparkSession, root: str, name: str) -> str | None:
    """What the greatest pointer says; one that is being written says nothing yet."""
    for number in reversed(_pointers(spark, root, name)):
        told = spark.read.text(f"{root}/{name}.latest/{number:010d}").first()
        if told:
            return told[0]
    return None


def _fs(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path
    return at(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, root: str) -> bool:
    fs, at = _fs(spark, root)
    return fs.exists(at(root))
