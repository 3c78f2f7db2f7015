"""Session settings the library is written for."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A skewed join may cost one more shuffle, but never leaves a third of the rows to one task.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # The JVM never compiles a longer method: wide rows in one generated method would be interpreted, several times slower.
    "spark.sql.codegen.hugeMethodLimit": "8000",
}


def local_session(cores: int = 8, name: str = "probity", **conf) -> SparkSession:
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for k, v in {
        **SETTINGS,
        "spark.sql.shuffle.partitions": str(cores),
        "spark.ui.enabled": "false",
        "spark.driver.memory": "12g",
        **conf,
    }.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return prepare(spark)


def ship_package(spark: SparkSession) -> None:
    """Gives the Python workers this package, wherever they run; once per application."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="probity-")) / "probity.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    sc.addPyFile(str(target))
    _SHIPPED.add(sc.applicationId)


_SHIPPED: set[str] = set()


def prepare(spark: SparkSession) -> SparkSession:
    """Ships the package and puts the settings that may be changed at run time on a session."""
    ship_package(spark)
    for k, v in SETTINGS.items():
        if spark.conf.get(k, None) != v:
            spark.conf.set(k, v)
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for cut points: the one the cluster names, a fresh local one if it names none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="probity-", dir=os.environ.get("TMPDIR", "/tmp")))
    return sc.getCheckpointDir()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Writes the rows once to the shared folder and reads them back.

    Later passes read only the columns they need, and a lost executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _WRITTEN.append(path)
    return spark.read.schema(df.schema).parquet(path)


_WRITTEN: list[str] = []
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_go(spark: SparkSession) -> Iterator[None]:
    """Tables written inside leave no shuffle files behind, so parts that follow each other take the disk of one."""
    before = spark.conf.get(SHUFFLES_GO, None)
    spark.conf.set(SHUFFLES_GO, "true")
    try:
        yield
    finally:
        spark.conf.unset(SHUFFLES_GO) if before is None else spark.conf.set(SHUFFLES_GO, before)


def delete(spark: SparkSession, folder: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> int:
    """Deletes the tables that :func:`cut_lineage` wrote in this application; nothing that reads them may run afterwards.

    Call it before the session stops. Returns how many tables went.
    """
    gone = 0
    while _WRITTEN:
        gone += bool(delete(spark, _WRITTEN.pop()))
    return gone
