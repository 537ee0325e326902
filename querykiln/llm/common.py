"""Shared helpers: shared-folder tables, connected components, safe columns."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

_WRITTEN: list[tuple[SparkSession, str]] = []
#: Set while a table is written: shuffle files go with their query; the order in which bucketed tables lie is used.
_SET = ("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "spark.sql.legacy.bucketedTableScan.outputOrdering")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where a local session leaves it unset (tests) is a temporary folder made and
    set as the checkpoint folder; on a cluster that is an error, since executors
    would each write to a folder of their own.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isEmpty() and not sc.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = held.get() if held.isDefined() else tempfile.mkdtemp(prefix="querykiln-")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(found)
    return found


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass


@atexit.register
def _clean() -> None:
    for spark, path in _WRITTEN:
        if spark.sparkContext._jsc is not None:
            _delete(spark, path)


@contextlib.contextmanager
def _swept(spark: SparkSession):
    """Shuffle files of the queries run inside go as each ends: what they made is written and needs them no more.

    Joins inside take a bucketed table as sorted where each bucket is one file.
    """
    before = {k: spark.conf.get(k, None) for k in _SET}
    for k in _SET:
        spark.conf.set(k, "true")
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


class Table:
    """A DataFrame written to the shared folder; ``drop`` deletes its files.

    small: its rows are few beside the input (links, pairs, labels), so four files a
    core will do, however many shuffle partitions there are. by: columns to bucket and
    sort by, so that later joins and groupings on them need no shuffle of this table;
    dealt: its rows are dealt by them already, to as many partitions as a shuffle has;
    codec: snappy where a table is read often, zstd where disk counts more.
    """

    def __init__(self, df: DataFrame, name: str, small: bool = False, by: tuple[str, ...] = (), dealt: bool = False, codec: str = "zstd"):
        self.spark, self.name = df.sparkSession, None
        key = uuid.uuid4().hex
        self.path = f"{shared_dir(self.spark).rstrip('/')}/querykiln/{name}-{key}"
        _WRITTEN.append((self.spark, self.path))
        if small:
            df = df.coalesce(4 * self.spark.sparkContext.defaultParallelism)
        with _swept(self.spark):
            if by:
                n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
                self.name = f"querykiln_{name.replace('-', '_')}_{key}"
                (df if dealt else df.repartition(n, *by)).write.bucketBy(n, *by).sortBy(*by).option("compression", codec).option("path", self.path).saveAsTable(self.name)
                self.df = self.spark.table(self.name)
            else:
                df.write.parquet(self.path)
                self.df = self.spark.read.schema(df.schema).parquet(self.path)

    def drop(self) -> None:
        if self.name:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        _delete(self.spark, self.path)


def materialize(df: DataFrame, name: str = "t") -> DataFrame:
    """Cut lineage: write ``df`` once to the shared folder and read it back."""
    return Table(df, name).df


def crc32_text(col: Column) -> Column:
    """crc32 of an id written as text; null ids count as the empty string."""
    return F.crc32(F.coalesce(col.cast("string"), F.lit("")).cast("binary"))


def columns_of(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns can't clash with ours."""
    return df.select(*(df[f"`{n}`"].alias(n) for n in names))


def _roots(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Spanning forest of the edges: each node with the smallest node it reaches."""
    nodes, inv = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(nodes)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    n = len(u)
    for a, b in zip(inv[:n].tolist(), inv[n:].tolist()):
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    roots = np.fromiter((find(i) for i in range(len(nodes))), np.int64, len(nodes))
    return nodes, nodes[roots]


def contract(batches):
    """Edges of a partition, a bounded block at a time, as a spanning forest."""
    held = []
    rows = 0

    def emit():
        both = pd.concat(held, ignore_index=True)
        node, root = _roots(both["u"].to_numpy(np.int64), both["v"].to_numpy(np.int64))
        far = node != root
        return pd.DataFrame({"u": node[far], "v": root[far]})

    for pdf in batches:
        held.append(pdf)
        rows += len(pdf)
        if rows >= 500_000:
            yield emit()
            held, rows = [], 0
    if held:
        yield emit()


def _star(sym: DataFrame, large: bool) -> DataFrame:
    """One star step over (u, v): hang neighbours on the smallest one seen."""
    low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    near = sym.join(low, "u")
    if large:  # larger neighbours go to the smallest
        return near.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of ``edges`` (u, v long) as (node, component).

    ``component`` is the smallest node reachable; nodes without an edge are
    absent. Edges are dealt by v, so that a node stands in the forest of one partition
    and of those where it is a hub u, not of all; each partition first shrinks its own
    edges to a spanning forest, a block at a time, then large-star and small-star steps
    alternate until nothing changes. Each round is written to the shared folder, so a
    lost executor only repeats a round. Minima are pre-aggregated, joins may be split.
    """
    edges = edges.select(F.col("u").cast("long"), F.col("v").cast("long")).where("u <> v")
    now = Table(edges.distinct().repartition("v").mapInPandas(contract, "u long, v long").distinct(), "edges", small=True)
    before = None
    for _ in range(max_rounds):
        both = now.df.unionByName(now.df.select(F.col("v").alias("u"), F.col("u").alias("v")))
        big = _star(both, True).where("u <> v")
        down = big.where("u > v").unionByName(big.where("u < v").select(F.col("v").alias("u"), F.col("u").alias("v")))
        small = _star(down, False).where("u <> v").distinct()
        new = Table(small, "edges", small=True)
        said = new.df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        now.drop()
        now = new
        if tuple(said) == before:
            break
        before = tuple(said)
    else:
        raise RuntimeError("components: no fixed point")
    return now.df.select(F.col("u").alias("node"), F.col("v").alias("component"))
