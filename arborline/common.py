"""Session helpers shared by all operators: table access, lineage cuts, partition counts."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """The table ``name`` of a directory of Parquet tables."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder that the session names in ``spark.checkpoint.dir``.

    Only a session whose executors are threads of the driver (tests, one machine) gets a folder of its own where none is
    named; on a cluster a missing setting is an error, since a folder of one machine cannot be read by the others.
    """
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = tempfile.mkdtemp(prefix="arborline-checkpoint-")
    spark.sparkContext.setCheckpointDir(path)
    return jsc.getCheckpointDir().get()


_stored: list[tuple[SparkSession, str]] = []


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there (a lost executor loses nothing).

    Partitions and their order are kept. The files are removed when the driver ends.
    """
    spark = df.sparkSession
    checkpoint_dir(spark)
    out = df.checkpoint(eager=True)
    try:
        _stored.append((spark, out._jdf.queryExecution().logical().rdd().getCheckpointFile().get()))
    except Exception:  # another plan node: the session's own cleaner has to remove the files
        pass
    return out


def _drop_stored() -> None:
    while _stored:
        spark, path = _stored.pop()
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended before
            pass


atexit.register(_drop_stored)


def stored(df: DataFrame) -> DataFrame:
    """Like ``cut``, but as a Parquet table in the shared folder: smaller, and with sizes that the planner knows.

    The order and number of partitions are not kept. The tables are removed when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _stored.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions of the session."""
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def running(df: DataFrame, by: list[str], order: list[str] | list[Column], value: str, name: str, kind: str = "sum") -> DataFrame:
    """Adds ``name``: over the rows of the same ``by`` up to a row, the sum of ``value``, or with ``kind`` max the maximum, or last the last value there is.

    Rows come in ``order``, which must be unique within ``by`` among rows with a value. They are range partitioned by (by,
    order) and written, so that a key with very many rows lies in many parts; what the parts before hold of a key comes
    from one row per key and part. No window goes over a key. Null values count as nothing.
    """
    n = partitions(df.sparkSession)
    parts = stored(df.repartitionByRange(n, *by, *order).withColumn("_part", F.spark_partition_id()))
    v = F.col(value)
    if kind == "last":
        total = F.max_by(v, F.when(v.isNotNull(), F.struct(*order)))
        over = lambda c, w: F.last(c, ignorenulls=True).over(w)
    else:
        total = F.sum(v) if kind == "sum" else F.max(v)
        over = lambda c, w: (F.sum(c) if kind == "sum" else F.max(c)).over(w)
    own = parts.groupBy(*by, "_part").agg(total.alias("_own"))
    past = own.select(*by, "_part", over("_own", W.partitionBy(*by).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)).alias("_past"))
    within = parts.withColumn("_within", over(value, W.partitionBy(*by, "_part").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)))
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_part")]
    if kind == "sum":
        both = F.coalesce(F.col("_past") + F.col("_within"), "_past", "_within")
    else:
        both = F.greatest("_past", "_within") if kind == "max" else F.coalesce("_within", "_past")
    return within.alias("a").join(past.alias("b"), same).select("a.*", "b._past").withColumn(name, both).drop("_part", "_past", "_within")


def finite(value: Column | str) -> Column:
    """``value`` as a double, with NaN and the infinities turned to null."""
    c = F.col(value) if isinstance(value, str) else value
    c = c.cast("double")
    return F.when(c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), c)


def normal_key(value: Column | str) -> Column:
    """A key without case and outer blanks; a blank one is null."""
    c = F.col(value) if isinstance(value, str) else value
    c = F.lower(F.regexp_replace(c, r"^\s+|\s+$", ""))
    return F.when(F.length(c) > 0, c)


def newest(df: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One row per key, the one with the greatest ``by`` (rows that agree in it: the greatest as a struct).

    ``max`` over a struct runs as a map-side combine, so that a key with very many rows does not pass through one task.
    Maps cannot be compared and must be dropped before.
    """
    rest = [c for c in df.columns if c not in keys and c != by]
    out = df.groupBy(*keys).agg(F.max(F.struct(by, *rest)).alias("_newest"))
    return out.select(*keys, "_newest.*").select(*df.columns)


def empty_like(df: DataFrame, schema: T.StructType) -> DataFrame:
    """An empty table of ``schema`` in the session of ``df``."""
    return df.sparkSession.createDataFrame([], schema)
