"""Session and table helpers shared by the whole package."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE_ROOT = Path(__file__).resolve().parent


def get_spark(app: str = "webloom", cores: str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benches; on a cluster use the session it gives you."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", os.environ.get("WEBLOOM_DRIVER_MEMORY", "8g"))
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One input table; the path goes to Spark's reader alone, so any store will do."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Put this package on the executors' Python path, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    out = Path(tempfile.mkdtemp(prefix="webloom-")) / "webloom_pkg.zip"
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE_ROOT.rglob("*.py")):
            z.write(p, f"webloom/{p.relative_to(PACKAGE_ROOT)}")
    spark.sparkContext.addPyFile(str(out))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``; only where that is unset and the master is local
    (tests, a laptop) one is made here. On a cluster without it this is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    if found is None and sc._jsc.sc().getCheckpointDir().isDefined():
        found = sc._jsc.sc().getCheckpointDir().get()
    if found is None:
        if sc.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="webloom-shared-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A place for a written table in the shared folder, which :func:`clear_written` of the same application deletes."""
    path = f"{shared_dir(spark)}/{tag}-{uuid.uuid4().hex}"
    _written.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once into the shared folder and read it back: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Tables written into the shared folder, by application.
_written: dict[str, list[str]] = {}


def written_so_far(spark: SparkSession) -> int:
    """How many places :func:`new_path` has given to this application."""
    return len(_written.get(spark.sparkContext.applicationId, []))


def clear_written(spark: SparkSession, since: int = 0, until: int | None = None) -> int:
    """Deletes the tables that this application has written so far (or between two counts of :func:`written_so_far`), for when no result that reads them is needed any more."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    paths = _written.get(spark.sparkContext.applicationId, [])
    gone = paths[since:until]
    for i, p in enumerate(gone, since):
        if p:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
        paths[i] = ""
    return sum(map(bool, gone))
