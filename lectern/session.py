"""Session helpers shared by the operators."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "lectern", cores: str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for one machine: tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def checkpoint_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the one that ``spark.checkpoint.dir`` names.

    Where none is named one is made in the local temporary folder, but on one machine only (a local master), as in
    tests; on a cluster that is refused.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="lectern-"))
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` written to the cluster's shared checkpoint folder, its lineage cut."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def ship(spark: SparkSession) -> None:
    """Makes this package importable in the session's Python workers, wherever they run; once for each session."""
    sc = spark.sparkContext
    if getattr(sc, "_lectern_shipped", False):
        return
    root = Path(__file__).resolve().parent
    out = Path(tempfile.mkdtemp(prefix="lectern-")) / "lectern_package.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(out))
    sc._lectern_shipped = True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; the path is read by Spark alone, so any store that Spark reads will do."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
