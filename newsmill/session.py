"""Session, tables and materialisation helpers shared by all operators."""

from __future__ import annotations

import functools
import os
import shutil
import tempfile

from pyspark import SparkConf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def get_spark(app: str = "newsmill", cores: str | int | None = None, **conf: str) -> SparkSession:
    """A session with the engine's defaults: UTC, adaptive execution, Arrow transfer.

    ``cores`` gives a local session (``"*"`` for all).  Without it the master is the submitter's (``spark-submit --master``,
    ``spark.master``), local only where none is set, and so are memory and the first number of shuffle partitions."""
    given = SparkConf()
    b = SparkSession.builder.appName(app)
    if cores is not None or not given.contains("spark.master"):
        b = b.master(f"local[{cores or '*'}]").config("spark.driver.memory", os.environ.get("NEWSMILL_DRIVER_MEMORY", "8g"))
        b = b.config("spark.sql.shuffle.partitions", "8")
    b = (
        b
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for k, v in conf.items():
        b = b.config(k.replace("__", "."), v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package on one machine, where it isn't on PYTHONPATH (a cluster gets it by
    PYTHONPATH or --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    sc = spark.sparkContext
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster") or getattr(sc, "_newsmill_shipped", False):
        return
    sc._newsmill_shipped = True
    if root not in [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]:
        sc.addPyFile(shutil.make_archive(os.path.join(tempfile.mkdtemp(prefix="newsmill-"), "newsmill"), "zip", root, "newsmill"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint_dir(spark: SparkSession) -> str:
    """The folder for checkpoints: ``spark.checkpoint.dir`` of the session; one of our own only where it is unset
    (single-machine runs such as tests); on a cluster it must be set."""
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    path = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir", None)
    if path is None and not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if path is None:
        path = "file://" + tempfile.mkdtemp(prefix="newsmill-checkpoint-")
    sc.setCheckpointDir(path)
    return sc._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage of ``df`` with a reliable checkpoint, so that losing an executor costs no recomputation of
    what came before and a result that is read twice is computed once."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: A key is hot from 1/HOT of the rows, so at most HOT keys are; a hot key is divided into SALTS shares.
HOT, SALTS = 256, 16


def hot_keys(sizes: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    """The keys with more than 1/HOT of the rows that ``sizes`` (a row a key, its rows in ``n``) counts: at most HOT
    rows.  ``sizes`` should be materialised."""
    total = sizes.agg(F.coalesce(F.sum(n), F.lit(0))).first()[0]
    return sizes.where(F.col(n) * HOT > F.lit(total)).select(*keys)


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str, hot: DataFrame, how: str = "left") -> DataFrame:
    """``left`` joined to ``right`` (one row a key) where some keys hold a large part of ``left``: rows of hot keys are
    divided by ``spread``, a column of ``left``, and the one row of ``right`` repeated for each share.  What is
    broadcast is ``hot``, at most HOT rows; null keys find no partner and are divided as well."""
    mark = F.broadcast(hot.select(*keys, F.lit(True).alias("__hot")))
    null = functools.reduce(lambda x, y: x | y, [F.col(k).isNull() for k in keys])
    share = F.when(F.col("__hot") | null, F.pmod(F.xxhash64(spread), F.lit(SALTS))).otherwise(0).cast("int")
    shares = F.when(F.col("__hot"), F.sequence(F.lit(0), F.lit(SALTS - 1))).otherwise(F.array(F.lit(0)))
    a = left.join(mark, keys, "left").withColumn("__salt", share).drop("__hot")
    b = right.join(mark, keys, "left").withColumn("__salt", F.explode(shares)).drop("__hot")
    return a.join(b, [*keys, "__salt"], how).drop("__salt")


#: Rows up to which one side of a join is broadcast.
SMALL = 200_000


def small_join(left: DataFrame, right: DataFrame, keys: list[str], spread: str, how: str = "left") -> DataFrame:
    """``left`` joined to ``right`` (one row a key, of a few numbers): broadcast while ``right``, which is materialised and
    counted, has at most SMALL rows, else with hot keys divided.  The result is the same either way."""
    right = cut(right)
    if right.count() <= SMALL:
        return left.join(F.broadcast(right), keys, how)
    return hot_join(left, right, keys, spread, hot_keys(cut(left.groupBy(*keys).agg(F.count("*").alias("n"))), keys), how)
