"""Session helpers: a local session for tests and benches, and the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Temporary folders of local sessions without ``spark.checkpoint.dir``, by application; the session's settings stay as they are.
_LOCAL_SCRATCH: dict[str, str] = {}


def local_session(cores: int | str = 8, app: str = "docketflow") -> SparkSession:
    """A local session for tests and benches; on a cluster use the session that is there."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder named by ``spark.checkpoint.dir``.

    Only a local session may go without that setting; it then gets a temporary folder. On a
    cluster the folder has to be shared, so a missing setting is an error there.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL_SCRATCH:
            _LOCAL_SCRATCH[app] = tempfile.mkdtemp(prefix="docketflow-")
        base = _LOCAL_SCRATCH[app]
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(scan: DataFrame, key: str) -> DataFrame:
    """Rows of a scan over all cores when it gives fewer tasks than that (one small file is one task).

    A table of many files comes back as it is: no shuffle.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan.repartition(cores, key) if scan.rdd.getNumPartitions() < cores else scan


def materialise(df: DataFrame, name: str, key: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, so a lost executor never re-runs its past.

    With a ``key``, a result too small to keep all cores busy is written once more, in one file per core.
    """
    spark = df.sparkSession

    def stored(rows: DataFrame) -> DataFrame:
        path = scratch_path(spark, name)
        rows.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    back = stored(df)
    if key is None:
        return back
    wide = spread(back, key)
    return back if wide is back else stored(wide)
