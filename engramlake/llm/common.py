"""What several operators of this subpackage need: tables, shared storage, free column names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words, as characters and as a pattern.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SPACE_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, else the one set by setCheckpointDir, else, on a local master, one beside
    the warehouse's tables."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return (found or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_shared").rstrip("/")


def durable(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """Write a frame as Parquet to the shared folder and read it back.

    This cuts the lineage in a way that outlives lost executors, and gives later
    joins a table whose size is known.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def observed(df: DataFrame, name: str, *totals: Column) -> tuple[DataFrame, tuple]:
    """As `durable`, and totals over the rows, taken while they are written."""
    seen = Observation()
    names = [f"total{k}" for k in range(len(totals))]
    out = durable(df.observe(seen, *[t.alias(n) for t, n in zip(totals, names)]), name)
    return out, tuple(seen.get[n] for n in names)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names like those given that no column of the frame has."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body) -> Column:
    """Bind a costly expression to a lambda variable, so that the body may use it many times but it is computed once."""
    return F.transform(F.array(value), body)[0]


def words_of(text: Column) -> Column:
    """Array of the words of a text, split at ASCII white space; empty for null."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RUN, -1))
