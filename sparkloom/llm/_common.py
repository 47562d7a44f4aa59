"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

#: A key that more than one in so many rows has is dealt over several tasks.
HOT_KEYS = 1000
#: ASCII white space as the operators' contracts list it: space and U+0009 to U+000D.
SPACE_CLASS = r"\x20\x09-\x0D"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, ``spark.checkpoint.dir``; one of our
    own only where driver and executors are one process."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = sc.getConf().get("spark.checkpoint.dir")
        if not named and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="sparkloom-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the shared folder, so that a lost
    executor costs a re-read and not a recomputation."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    return path


def written(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """``df`` as a compressed columnar table in the shared folder: for
    intermediate tables that are read more than once or column by column."""
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", "zstd").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def arrow_type(df: DataFrame, column: str) -> pa.DataType:
    """The Arrow type in which tasks get and give back a column of ``df``."""
    return to_arrow_type(df.schema[column].dataType)


def free_names(*wanted: str, beside: DataFrame) -> list[str]:
    """``wanted``, changed where ``beside`` has columns of these names."""
    taken = {c.lower() for c in beside.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_hot(rows: DataFrame, by_key: DataFrame, key: str, times: str, total: int, spread: Column) -> DataFrame:
    """Inner join of ``rows`` with ``by_key``, which has one row a key and in
    ``times`` how many of the ``total`` rows have it.

    Rows of a hot key (fewer than ``HOT_KEYS`` keys are, so that list is
    broadcast) are dealt by ``spread`` over as many places as their share of
    all rows asks for, and the key's row is sent to each of these.
    """
    share = F.col(times) * F.lit(HOT_KEYS / max(1, total))
    hot = by_key.where(share > 1).select(key, F.ceil(share).cast("int").alias("__deals"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("__deal", F.coalesce(F.pmod(spread, F.col("__deals")), F.lit(0)).cast("int")).drop("__deals")
    sent = by_key.withColumn("__deal", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(share), F.lit(1)).cast("int") - 1)))
    return dealt.join(sent, [key, "__deal"]).drop("__deal")
