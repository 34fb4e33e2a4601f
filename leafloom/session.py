"""Session settings and the folder in which lineage is cut."""

from __future__ import annotations

import os
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def let_workers_import(spark: SparkSession) -> SparkSession:
    """Put the folder of this package on the path of the session's Python workers, wherever the session was started."""
    root, env = str(Path(__file__).resolve().parents[1]), spark.sparkContext.environment
    there = env.get("PYTHONPATH", "")
    if root not in there.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [root, there]))
    return spark


def local_session(cores: int | str = 8, app: str = "leafloom") -> SparkSession:
    """A local session for tests and the bench; a cluster brings its own."""
    return let_workers_import(
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named in ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own; on a cluster that would lie on one machine, so it raises.
    """
    there = spark.conf.get("spark.checkpoint.dir", None)
    if there:
        return there
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="leafloom-checkpoint-")


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and read it from there from now on.

    Unlike a cached or locally checkpointed frame it survives the loss of executors.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_dir(spark))
    return df.checkpoint(eager=True)
