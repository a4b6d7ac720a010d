"""Operator defaults and session helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class Settings:
    """Defaults of the operators, in one place. Pass changed copies with ``dataclasses.replace``."""

    # Default prices, cache lifetime, retry and rate-limit constants.
    price_in: float = 3.00
    price_out: float = 15.00
    cache_ttl_seconds: int = 300
    cache_max_entries: int = 1000
    max_retries: int = 3
    backoff_ms: int = 500
    rate_window_seconds: int = 60
    recent_activity: int = 50
    # None = the feature is off.
    budgets: dict[str, float] | None = field(default=None, hash=False)


DEFAULTS = Settings()


def build_session(app: str = "sensitext", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect. On a cluster leave ``master`` to spark-submit."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master).config("spark.ui.enabled", "false")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


_LOCAL_SCRATCH: dict[str, str] = {}


def scratch_folder(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``. Only a local session may do without it."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    application = spark.sparkContext.applicationId
    if application not in _LOCAL_SCRATCH:
        _LOCAL_SCRATCH[application] = tempfile.mkdtemp(prefix="sensitext-")
    return _LOCAL_SCRATCH[application]


def cut_lineage(df: DataFrame, name: str = "step") -> DataFrame:
    """Writes ``df`` once to the scratch folder and reads it back: frozen rows with known sizes.

    Later steps that read it several times neither repeat the work before it nor depend on executors
    that may be gone. The table stays until ``clean_scratch`` or the end of a ``scratch`` block; the shuffle
    files behind it go at once, for else they stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{scratch_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.setdefault(spark.sparkContext.applicationId, []).append(path)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


#: Of Spark 4.1 on: a statement deletes its own shuffle files when it ends.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_WRITTEN: dict[str, list[str]] = {}


def clean_scratch(spark: SparkSession, since: int = 0) -> int:
    """Deletes what ``cut_lineage`` has written in this application, from the ``since``-th table on; returns how many.

    Results that read those tables cannot be computed afterwards: write them out first.
    """
    written = _WRITTEN.get(spark.sparkContext.applicationId, [])
    going = written[since:]
    del written[since:]
    for path in going:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return len(going)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was written inside: ``with scratch(spark): redact_table(...)[0].write...``."""
    since = len(_WRITTEN.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        clean_scratch(spark, since)
