"""Tables that several questions read: written once as Parquet in the folder that the cluster shares, then only read."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_lock = threading.RLock()
_kept: dict[tuple[str, ...], str] = {}
_folders: dict[str, str] = {}
_shipped: set[str] = set()
PACKAGE = Path(__file__).resolve().parent.parent


def folder(spark: SparkSession) -> str:
    """This application's folder below ``spark.checkpoint.dir``; a temporary one only where that is unset and all runs in one process."""
    app = spark.sparkContext.applicationId
    with _lock:
        if app not in _folders:
            named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
            if named:
                _folders[app] = f"{named}/kept-{uuid.uuid4().hex}"
            elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
                own = tempfile.mkdtemp(prefix="loomstead-kept-")
                atexit.register(shutil.rmtree, own, ignore_errors=True)
                _folders[app] = f"file://{own}"
            else:
                raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        return _folders[app]


def ship(spark: SparkSession) -> None:
    """Make this package importable on the executors, which need not share the driver's folders."""
    sc = spark.sparkContext
    with _lock:
        if sc.applicationId in _shipped:
            return
        _shipped.add(sc.applicationId)
        to = Path(tempfile.mkdtemp(prefix="loomstead-code-")) / "loomstead_library.zip"
        atexit.register(shutil.rmtree, to.parent, ignore_errors=True)
        with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
            for p in sorted(PACKAGE.rglob("*.py")):
                z.write(p, str(Path(PACKAGE.name) / p.relative_to(PACKAGE)))
        sc.addPyFile(str(to))


def kept(spark: SparkSession, root: str, name: str, make: Callable[[], DataFrame], sort: str | None = None) -> DataFrame:
    """The table ``name`` derived from the tables under ``root``, made at the first call in this application. ``sort``: rows are ranged by it, so that readers skip files."""
    key = (spark.sparkContext.applicationId, root, name)
    with _lock:
        if key not in _kept:
            df = make()
            if sort:
                df = df.repartitionByRange(sort).sortWithinPartitions(sort)
            path = f"{folder(spark)}/{name}-{uuid.uuid4().hex[:8]}"
            df.write.option("compression", "zstd").parquet(path)
            _kept[key] = path
        return spark.read.parquet(_kept[key])


def held(spark: SparkSession, root: str, name: str) -> DataFrame | None:
    """The table ``name`` if this application has already written it."""
    with _lock:
        path = _kept.get((spark.sparkContext.applicationId, root, name))
    return spark.read.parquet(path) if path else None


def bounded(df: DataFrame, most: int = 500_000) -> DataFrame:
    """``df`` settled, and told to be broadcast where it has at most ``most`` rows."""
    from pyspark.sql import functions as F

    df = settled(df)
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def settled(df: DataFrame) -> DataFrame:
    """``df`` written to the application's folder and read back: what follows doesn't make it again, and lineage ends there."""
    path = f"{folder(df.sparkSession)}/step-{uuid.uuid4().hex[:12]}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Rows of ``new``, and those of ``old`` whose key isn't in it: vertices merged by key, as loading a batch again would."""
    return old.join(new.select(key), key, "left_anti").select(*new.columns).unionByName(new.dropDuplicates([key]))


def write_generation(rows: DataFrame, path: str, gen: str) -> None:
    """Rows of one load as a partition of its own; an earlier load of the same generation is replaced, others stay."""
    from pyspark.sql import functions as F

    rows.withColumn("gen", F.lit(gen)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("gen").parquet(path)
