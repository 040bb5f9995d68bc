"""What the operators share: tables in the cluster's shared folder, the package on the executors, reading columns."""

from __future__ import annotations

import atexit
import io
import re
import tempfile
import threading
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PACKAGE = Path(__file__).resolve().parent.parent
_lock = threading.Lock()
_folders: dict[str, str] = {}
_shipped: set[str] = set()
_tables: dict[str, list[str]] = {}


def shared_folder(spark: SparkSession) -> str:
    """A folder under ``spark.checkpoint.dir`` for this application; a temporary one only where that is unset and all runs in one process."""
    sc = spark.sparkContext
    with _lock:
        if sc.applicationId not in _folders:
            root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
            if not root and not re.fullmatch(r"local(\[.*\])?", sc.master):
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
            if not root:
                root = "file://" + tempfile.mkdtemp(prefix="loomstead-")
                sc.setCheckpointDir(root)
            _folders[sc.applicationId] = f"{root}/loomstead-{uuid.uuid4().hex}"
            atexit.register(_remove, spark, sc.applicationId)
        return _folders[sc.applicationId]


def _remove(spark: SparkSession, app: str) -> None:
    """Drops this application's scratch tables and its folder; also to be called by who ends the session earlier."""
    folder = _folders[app]
    try:
        for name in _tables.pop(app, []):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may have ended already
        pass


def scratch_table(spark: SparkSession) -> str:
    """A name for a table of the catalog that goes with this application's folder."""
    name = f"loomstead_{uuid.uuid4().hex}"
    shared_folder(spark)
    with _lock:
        _tables.setdefault(spark.sparkContext.applicationId, []).append(name)
    return name


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there, and any executor can reread it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, which need not share the driver's folders."""
    sc = spark.sparkContext
    with _lock:
        if sc.applicationId in _shipped:
            return
        _shipped.add(sc.applicationId)
        packed = io.BytesIO()
        with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(PACKAGE.rglob("*.py")):
                z.write(p, str(Path(PACKAGE.name) / p.relative_to(PACKAGE)))
        to = Path(tempfile.mkdtemp(prefix="loomstead-code-")) / "loomstead_code.zip"
        to.write_bytes(packed.getvalue())
        sc.addPyFile(str(to))


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def need(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under our own names: extra columns can't clash with what an operator makes."""
    return df.select(*[F.col(f"`{theirs}`").alias(ours) for ours, theirs in columns.items()])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
