"""Session helpers: a local session for tests and benches, and shipping of this package to executors."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

#: Rows of one Arrow batch that Python operators get; texts can be long, so a batch must stay small.
BATCH_ROWS = 256

_SHIPPED: set[str] = set()


def local_session(cores: int | str = 8, partitions: int = 8, **more: str) -> SparkSession:
    """A session for one machine, as tests and the bench use it; ``more`` are further settings with _ for dots."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("folioscope")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("FOLIO_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config(map={k.replace("_", "."): v for k, v in more.items()})
        .getOrCreate()
    )


def ship(spark: SparkSession) -> SparkSession:
    """Send this package to the executors once per application and keep Arrow batches small.

    Python workers import operator modules by name, so executors need the package even where it is not
    installed. A second call is free. Plans read the size of batches when they run, so it stays lowered for the session;
    a smaller one that the caller has set is kept.
    """
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(size)) <= BATCH_ROWS:
        spark.conf.set(size, str(BATCH_ROWS))
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        here = os.path.dirname(os.path.abspath(__file__))
        if os.path.isdir(here):
            top = tempfile.mkdtemp()
            atexit.register(shutil.rmtree, top, ignore_errors=True)
            shutil.copytree(here, f"{top}/in/{os.path.basename(here)}", ignore=shutil.ignore_patterns("__pycache__"))
            spark.sparkContext.addPyFile(shutil.make_archive(f"{top}/{os.path.basename(here)}_{os.getpid()}", "zip", f"{top}/in"))
        _SHIPPED.add(app)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
