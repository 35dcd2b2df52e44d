"""Session helpers: local defaults for tests and checkpoint handling for clusters."""

from __future__ import annotations

import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A local session with the settings the operators expect (UTC, AQE on)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tidemark")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the shared folder that the cluster names in ``spark.checkpoint.dir``.

    Where it is unset, a local session (one machine, as in tests) gets its own; on a cluster this is an error.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured is None and not context.master.split("[")[0] == "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(configured or LOCAL_CHECKPOINTS)


def ship_package(spark: SparkSession, folder: str | Path) -> None:
    """Send this package to the Python workers, for sessions whose executors can't import it. The archive is made in ``folder``."""
    root = Path(__file__).resolve().parent
    archive = Path(folder) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, path.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(archive))


def materialize(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: cuts lineage and survives executor loss.

    Used where one input feeds many driver-steered passes (Newton steps, boosted trees).
    """
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stored(df: DataFrame) -> DataFrame:
    """As ``materialize``, but as Parquet files in the checkpoint folder: for many rows whose columns hold few values."""
    spark = df.sparkSession
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.parquet(path)
