"""Small Spark helpers that the operators of this package share."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names for checkpoints. Where none is named, a temporary one in a local session, and a RuntimeError on a cluster."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="panelwright-")
    spark.sparkContext.setCheckpointDir(f"file://{folder}")
    return f"file://{folder}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and return the table read back.

    This cuts the lineage: an executor lost later costs a reread, not a rerun.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sheltered(docs: DataFrame, used: list[str], added: list[str]) -> tuple[DataFrame, dict[str, str]]:
    """(frame, names): the columns ``used``, and the others under names that nothing else has.

    Columns of the names in ``added`` are left out. names gives each column's name in
    the frame, in the order of docs.
    """
    names = {c: c if c in used else f"other_{i}" for i, c in enumerate(docs.columns) if c not in added}
    return docs.select(*[F.col(f"`{c}`").alias(x) for c, x in names.items()]), names


def unsheltered(df: DataFrame, names: dict[str, str], added: list[str]) -> DataFrame:
    """The columns of docs under their own names, then those added."""
    return df.select(*[F.col(x).alias(c) for c, x in names.items()], *added)


def extended(df: DataFrame, ddl: str) -> StructType:
    """The schema of df with more fields, for mapInArrow."""
    return StructType([*df.schema.fields, *StructType.fromDDL(ddl).fields])


def release(df: DataFrame) -> None:
    """Let Spark's cleaner delete the shuffle files of finished steps now, not at its next half-hourly collection."""
    gc.collect()
    df.sparkSession._jvm.System.gc()
