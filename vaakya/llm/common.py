"""What several operators share: input tables, scratch tables, connected components.

Scratch tables are Parquet files under ``spark.checkpoint.dir`` (the folder the
cluster shares), so a lost executor costs a reread and never the lineage. A
folder of our own is set only where that setting is empty and the master is
local, as in tests; elsewhere an empty setting is an error.
"""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCRATCH: list[tuple] = []

#: Rows of one Arrow batch; documents can be long, so batches are short.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named table of ``sf_dir``, by Spark's reader only."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or sc._jsc.sc().getCheckpointDir().getOrElse(None)
    if not path:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        path = "file://" + tempfile.mkdtemp(prefix="vaakya-")
        sc.setCheckpointDir(path)
    return str(path).rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder name below the shared one, removed when the driver ends."""
    path = f"{shared_dir(spark)}/vaakya-{uuid.uuid4().hex}/{name}"
    if not _SCRATCH:
        atexit.register(_clean)
    _SCRATCH.append((spark, path))
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a scratch folder through Hadoop's file system."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path).getParent()
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def drop(*tables: DataFrame) -> None:
    """Deletes stored tables that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, t.scratch_path)


def _clean() -> None:
    for spark, path in _SCRATCH:
        try:
            remove(spark, path)
        except Exception:  # noqa: BLE001 - the JVM may be gone at exit
            return


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns the written table."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


#: The column that ``numbered`` adds.
ROW = "_vaakya_row"


def numbered(df: DataFrame) -> DataFrame:
    """``df`` stored with a number for each row in ``ROW``, the same at every reading."""
    return materialize(df.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def arrow_rows(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds the rows of a batch that a Python worker holds at once."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def trim() -> None:
    """Gives the system back what this process has freed, where its C library can do so."""
    with contextlib.suppress(AttributeError, OSError):
        ctypes.CDLL(None).malloc_trim(0)


def connected_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(u, v) edges of longs -> (node, component), component the smallest node reached.

    Alternating large-star and small-star steps: a logarithmic number of
    rounds for paths too, each a partial aggregate and an equi-join that
    adaptive execution can split at a hub. Self loops and repeated edges are
    allowed; nodes without an edge to another node are not returned; null
    ends are ignored. No edges leave the cluster: rounds compare a checksum.
    """
    cur = materialize(
        edges.where("u is not null and v is not null and u <> v")
        .select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u"))
        .distinct()
        .select("u", "v"),
        "edges",
    )

    def mark(df: DataFrame) -> tuple:
        row = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        return tuple(row)

    seen = mark(cur)
    for _ in range(max_rounds):
        if not seen[0]:
            break
        both = cur.union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(small_low, "u")
        small = (
            joined.select(F.explode(F.array(F.struct("v", "m"), F.struct(F.col("u").alias("v"), "m"))).alias("e"))
            .select(F.col("e.v").alias("u"), F.col("e.m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        nxt = materialize(small, "edges")
        now = mark(nxt)
        remove(cur.sparkSession, cur.scratch_path)
        cur = nxt
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return cur.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        cur.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
