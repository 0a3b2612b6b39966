"""Session helpers that every operator shares: table access, partition counts, lineage cuts."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Sequence

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, root: str, name: str, *columns: str) -> DataFrame:
    """One table of a data folder. Naming columns keeps clashing extra columns out of the plan."""
    df = spark.read.parquet(os.path.join(root, f"{name}.parquet"))
    return df.select(*columns) if columns else df


def shuffle_partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts.

    The cluster names it in ``spark.checkpoint.dir``. Where that is unset a temporary folder is used
    if all executors are in this process, as in tests; on a cluster it is an error.
    """
    jsc = spark.sparkContext._jsc.sc()
    current = jsc.getCheckpointDir()
    if current.isDefined():
        return current.get()
    named = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getConf().get("spark.checkpoint.dir", "")
    if not named and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="skerry-checkpoint-"))
    return jsc.getCheckpointDir().get()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and go on from there."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _file_system(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    return jvm, conf, jvm.org.apache.hadoop.fs.Path(path).getFileSystem(conf)


def numbered_files(spark: SparkSession, folder: str) -> dict[int, str]:
    """The texts of the files ``<number>.json`` of a folder, by number."""
    jvm, _, fs = _file_system(spark, folder)
    root = jvm.org.apache.hadoop.fs.Path(folder)
    found: dict[int, str] = {}
    for status in fs.listStatus(root) if fs.exists(root) else ():
        name = status.getPath().getName()
        if name.endswith(".json") and name[0].isdigit():
            stream = fs.open(status.getPath())
            try:
                found[int(name.removesuffix(".json"))] = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
            finally:
                stream.close()
    return found


def write_once(spark: SparkSession, path: str, text: str, by_link: bool | None = None) -> None:
    """A file that appears whole and only where none of its name is; else ``FileExistsError``.

    The text is written beside it and put in place in one step: by a link on a local file system,
    elsewhere by a rename that doesn't overwrite, which the file system must do in one step.
    """
    jvm, conf, fs = _file_system(spark, path)
    target = jvm.org.apache.hadoop.fs.Path(path)
    staged = jvm.org.apache.hadoop.fs.Path(f"{target.getParent().toString()}/.staged-{uuid.uuid4().hex}")
    stream = fs.create(staged, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if fs.getScheme() == "file" if by_link is None else by_link:
            local = lambda p: jvm.java.io.File(p.toUri().getPath()).toPath()
            jvm.java.nio.file.Files.createLink(local(target), local(staged))
            fs.delete(staged, False)
        else:
            none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(staged, target, none)
    except Py4JJavaError as e:
        fs.delete(staged, False)
        if fs.exists(target):
            raise FileExistsError(path) from e
        raise


#: Rows up to which a side of a join is broadcast; those meant here are of some 100 bytes.
BROADCAST_ROWS = 200_000


def measured_side(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df``, written and counted, as the side of a join: broadcast if it has few rows, else left to an exchange."""
    side = cut_lineage(df)
    return F.broadcast(side) if side.count() <= most_rows else side


def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``df`` with the place of each row in a total order, from 0, without bringing all rows together.

    Rows are range-partitioned and written; each partition numbers its own and adds what lies before it.
    """
    spark = df.sparkSession
    ranged = cut_lineage(df.repartitionByRange(shuffle_partitions(spark), *order).withColumn("skerry_part", F.spark_partition_id()))
    counts = ranged.groupBy("skerry_part").agg(F.count("*").alias("n"))  # a row for each partition
    before = counts.select("skerry_part", F.coalesce(F.sum("n").over(Window.orderBy("skerry_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("skerry_before"))
    place = F.row_number().over(Window.partitionBy("skerry_part").orderBy(*order)) - 1 + F.col("skerry_before")
    return ranged.join(F.broadcast(before), "skerry_part").withColumn(name, place).drop("skerry_part", "skerry_before")


#: Input splits for each core that CPU-heavy Python stages want at least.
SPLITS_PER_CORE = 3


def spread(df: DataFrame) -> DataFrame:
    """``df`` in enough partitions to keep all cores busy in a CPU-heavy stage.

    A large scan has more splits than that already and is left alone, so no corpus is
    shuffled for it; only small inputs of few files or row groups are dealt out.
    """
    wanted = SPLITS_PER_CORE * df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= wanted else df.repartition(wanted)
