"""Sources and sinks: table folders, COPY, generated rows, partitions."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.operators.relational import with_rownum

#: COPY option names and those of Spark's reader and writer.
COPY_OPTIONS = {"delimiter": "sep", "null": "nullValue", "quote": "quote", "escape": "escape", "encoding": "encoding", "header": "header"}


def table(spark: SparkSession, folder: str, name: str, alias: str | None = None, columns: Sequence[str] | None = None) -> DataFrame:
    """A base table, AS alias (columns)."""
    df = spark.read.parquet(f"{folder}/{name}.parquet")
    df = df.toDF(*columns) if columns else df
    return df.alias(alias) if alias else df


def copy_to(df: DataFrame, path: str, **options: str) -> None:
    """COPY (query) TO: delimited text."""
    df.write.mode("overwrite").options(**{COPY_OPTIONS[k]: v for k, v in options.items()}).csv(path)


def copy_from(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """COPY table FROM: delimited text with a given schema; never inferred."""
    return spark.read.schema(schema).options(**{COPY_OPTIONS[k]: v for k, v in options.items()}).csv(path)


def export(df: DataFrame, path: str, kind: str = "json") -> None:
    """Rows as files: json (a row a line), csv (with a header), or text (one column)."""
    {"json": df.write.mode("overwrite").json, "csv": df.write.mode("overwrite").option("header", True).csv, "text": df.write.mode("overwrite").text}[kind](path)


def nextval(df: DataFrame, out: str, start: int = 1, step: int = 1) -> DataFrame:
    """A sequence's NEXTVAL for each row: contiguous, in the order of the rows as they come."""
    return with_rownum(df, out).withColumn(out, (F.col(out) - 1) * step + start)


def generate_series(spark: SparkSession, start: int, stop: int, step: int = 1, name: str = "generate_series") -> DataFrame:
    """Rows from start to stop, both included; made on the executors."""
    return spark.range(start, stop + (1 if step > 0 else -1), step).withColumnRenamed("id", name)


def values(spark: SparkSession, schema: str, *rows: tuple) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def create_table_as(df: DataFrame, path: str, *partition_by: str) -> DataFrame:
    """CREATE TABLE AS / SELECT INTO at a path, partitioned; the table is returned."""
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def partition(df: DataFrame, column: str, value: object) -> DataFrame:
    """table PARTITION FOR (value): a filter that prunes partitions at the scan."""
    return df.where(F.col(column) == F.lit(value))


def overwrite_partitions(df: DataFrame, path: str, *partition_by: str) -> None:
    """Writes to a partitioned table, over the partitions that ``df`` has rows
    of and no others: DML on PARTITION (p), or a statement that changed some."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).parquet(path)


#: Encodings of SQL files in the order in which they are tried (fixed values).
ENCODINGS = ["UTF-8", "EUC-JP", "EUC-KR", "GB18030", "BIG5"]


def decoded(content: Column) -> Column:
    """Struct (text, encoding) of a file's bytes: by byte order mark, else the
    first encoding in which they are valid; else UTF-8 with marks for what isn't."""

    def one(data: bytes | None) -> tuple[str | None, str | None]:
        if data is None:
            return None, None
        for mark, name in ((b"\xff\xfe", "UTF-16LE"), (b"\xfe\xff", "UTF-16BE")):
            if data.startswith(mark):
                return data[2:].decode(name, "replace"), name
        for name in ENCODINGS:
            try:
                return data.decode(name), name
            except UnicodeDecodeError:
                pass
        return data.decode("UTF-8", "replace"), "UTF-8-lossy"

    @F.pandas_udf("text string, encoding string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for contents in batches:
            yield pd.DataFrame([one(c) for c in contents], columns=["text", "encoding"])

    return run(content)


def text_files(spark: SparkSession, path: str, encoding: str | None = None) -> DataFrame:
    """path, content of whole files: scripts, mapper XML, Java sources; the
    encoding is looked for unless it is given."""
    files = spark.read.format("binaryFile").load(path)
    return files.select("path", (F.decode("content", encoding) if encoding else decoded(F.col("content"))["text"]).alias("content"))
