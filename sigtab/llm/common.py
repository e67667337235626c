"""Reading tables, shared scratch tables and bounded samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructType


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only a local master may go without it; it then gets a temporary folder of this machine.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="sigtab-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: later work starts from these files."""
    path = f"{shared_folder(df.sparkSession)}/llm/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Delete tables of ``stored`` that no later step reads."""
    for df in tables:
        path = getattr(df, "_stored_at", None)
        if path:
            context = df.sparkSession.sparkContext
            where = context._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(context._jsc.hadoopConfiguration()).delete(where, True)


def fold(column: Column, parts: int) -> Column:
    """crc32 of the column as text, modulo ``parts``."""
    return F.crc32(column.cast("string")) % parts


def bounded(df: DataFrame, key: Column, rows: int) -> DataFrame:
    """At most about ``rows`` rows, chosen by a hash of ``key`` alone; all rows if there are no more."""
    there = df.count()
    if there <= rows:
        return df
    return df.where(F.pmod(F.xxhash64(key, F.lit("sample")), F.lit(1 << 40)) < int((1 << 40) * rows / there))


def with_columns(df: DataFrame, keep: list[str], new: dict[str, str], first: dict[str, str] | None = None) -> StructType:
    """The schema of new columns ``first``, the columns ``keep`` of ``df`` and the new columns ``new``."""
    out = StructType()
    for name, kind in (first or {}).items():
        out = out.add(name, DataType.fromDDL(kind))
    for name in keep:
        out = out.add(df.schema[name])
    for name, kind in new.items():
        out = out.add(name, DataType.fromDDL(kind))
    return out


def to_workers(spark: SparkSession, value):
    """Send a value of bounded size to the workers once; call the result inside a task to get it."""
    sent, kept = spark.sparkContext.broadcast(cloudpickle.dumps(value)), []

    def get():
        if not kept:
            kept.append(cloudpickle.loads(sent.value))
        return kept[0]

    return get
