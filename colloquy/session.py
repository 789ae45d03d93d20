"""Session helper and the shared folder for intermediate tables."""

from __future__ import annotations

import io
import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_folders: dict[str, str] = {}


def local_session(cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """Session for tests and benches on one machine. A cluster brings its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("colloquy")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers import it; once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = Path(__file__).resolve().parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for f in sorted(package.rglob("*")):
            if f.is_file() and f.suffix in (".py", ".json"):
                z.write(f, f.relative_to(package.parent))
    # addPyFile takes a path on the driver and serves the file from there.
    path = os.path.join(tempfile.mkdtemp(prefix="colloquy-package-"), "colloquy.zip")
    Path(path).write_bytes(packed.getvalue())
    spark.sparkContext.addPyFile(path)
    _shipped.add(app)


def shared_folder(spark: SparkSession) -> str:
    """This application's folder for written intermediate tables: below spark.checkpoint.dir, else below the warehouse.

    Both are shared by the driver and all executors. Spark deletes the folder when the application ends.
    """
    app = spark.sparkContext.applicationId
    if app not in _folders:
        root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
        folder = f"{root.rstrip('/')}/colloquy-{app}"
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        files = path.getFileSystem(spark._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
        _folders[app] = folder
    return _folders[app]


def written(df: DataFrame, label: str, codec: str | None = None) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back.

    This cuts the lineage; the copy survives the loss of executors and keeps column pruning and
    filter pushdown for its readers. `codec` packs it otherwise than the session does.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    (df.write.option("compression", codec) if codec else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path)
