"""Tables of an archive, read from Parquet folders; JSON and Markdown sources."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NAMES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(spark: SparkSession, sf_dir: str) -> None:
    for name in NAMES:
        load(spark, sf_dir, name).createOrReplaceTempView(name)


def json_records(spark: SparkSession, path: str) -> DataFrame:
    """One record or a list of records per file; gzip is read by its suffix."""
    return spark.read.option("multiLine", True).json(path)


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, front, body): the front matter between the first two lines of three dashes, and the rest."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True).withColumn("path", F.input_file_name())
    pattern = r"(?s)\A---\r?\n(.*?)\r?\n---\r?\n?(.*)\z"
    found = F.regexp_extract("value", pattern, 1)
    has = F.col("value").rlike(pattern)
    return raw.select("path", F.when(has, found).otherwise("").alias("front"), F.when(has, F.regexp_extract("value", pattern, 2)).otherwise(F.col("value")).alias("body"))


def replace_days(new: DataFrame, path: str, day: str = "day") -> None:
    """Write new over the same days of the table at path; other days stay (late data replaces its range)."""
    new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(day).parquet(path)


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh folder that driver and executors share: in spark.checkpoint.dir or, on a local master only, a temporary one."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="folioscope-")
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def kept(df: DataFrame, label: str) -> DataFrame:
    """df, written to a fresh shared folder and read again: its lineage ends here, and a lost executor loses nothing of it."""
    path = scratch(df.sparkSession, label)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def promote(df: DataFrame, path: str, gate: Callable[[DataFrame], list[str]]) -> list[str]:
    """Write df beside path, read it back, ask the gate, and put it in place of path only if the gate finds nothing.
    Returns what the gate found; path is then as it was."""
    spark = df.sparkSession
    draft, old = f"{path}.staged-{uuid.uuid4().hex}", f"{path}.old-{uuid.uuid4().hex}"
    df.write.parquet(draft)
    found = gate(spark.read.schema(df.schema).parquet(draft))
    Path = spark._jvm.org.apache.hadoop.fs.Path
    fs = Path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if found:
        fs.delete(Path(draft), True)
        return found
    held = fs.exists(Path(path))
    if held:
        fs.rename(Path(path), Path(old))
    if not fs.rename(Path(draft), Path(path)):
        if held:
            fs.rename(Path(old), Path(path))
        raise OSError(f"could not put {draft} in place")
    fs.delete(Path(old), True)
    return []
