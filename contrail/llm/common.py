"""Shared helpers of the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is what the cluster names in spark.checkpoint.dir. Only a local session without that setting gets a
    temporary folder; a cluster without it is an error, since executors don't see each other's local disks.
    """
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if found:
        return found
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return sc.getCheckpointDir()


def new_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder, deleted when the session ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jvm_path)
    return path


def stage(df: DataFrame, name: str, rows: int = 0) -> DataFrame:
    """df as a written table: it cuts the lineage, survives lost executors and has a known size. rows: of a file at most (0: any number)."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.option("compression", "zstd").option("maxRecordsPerFile", rows).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(col):
    """Lower-cases A-Z only."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(col, upper, upper.lower())


def slices(sizes, limit: int):
    """Cuts items of these sizes into slices of about limit, so that a batch of large ones stays small."""
    begin = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield begin, i
            begin = i
            total = 0
        total += size
    if begin < len(sizes):
        yield begin, len(sizes)


def batches_of(texts: list, limit: int = 1 << 22):
    """Slices of a list of texts of about limit characters."""
    return slices([len(t) for t in texts], limit)


def crc32_mod(doc_id, n: int):
    """crc32 of an id's decimal text (null: empty text), modulo n."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def join_hot(rows: DataFrame, values: DataFrame, key: str, hot: int = 100, most: int = 10_000) -> DataFrame:
    """rows left-joined with values on key, where a few keys may hold many of the rows.

    values has one row a key, which isn't null, and `n`, how many rows of that key there are at least about. Of the
    keys with more than `hot` rows the `most` hottest are broadcast, which is a fixed bound; all others are shuffled.
    """
    names = [c for c in values.columns if c not in (key, "n")]
    few = values.where(F.col("n") > hot).orderBy(F.desc("n"), key).limit(most)
    met = rows.join(F.broadcast(few.select(key, F.struct(*names).alias("hot_value"))), key, "left")
    done = met.where("hot_value IS NOT NULL").select(*rows.columns, *(F.col(f"hot_value.{c}").alias(c) for c in names))
    return done.unionByName(met.where("hot_value IS NULL").drop("hot_value").join(values.drop("n"), key, "left"))
