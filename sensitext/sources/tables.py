"""Readers and writers with explicit schemas (no schema inference pass over the data)."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators.audit import EVENT, rfc3339
from ..operators.registry import CHANGES, USERS

REQUESTS = (
    "request_id bigint, ts timestamp, method string, path string, source string, authorization string, "
    "target string, scope string, body string"
)
RESPONSES = "request_id bigint, ts timestamp, status int, body string"
ATTEMPTS = "request_id bigint, target_ord int, target string, attempt int, status int, error string"


#: Where JSON lines that do not parse are kept in request, response and attempt logs.
CORRUPT = "_corrupt_record"


def _read(spark: SparkSession, path: str, schema: str, format: str) -> DataFrame:
    """A log; a JSON line that does not parse stays as a row with its text in ``_corrupt_record``."""
    if format == "json":
        schema = f"{schema}, {CORRUPT} string"
    return spark.read.schema(schema).format(format).load(path)


def spread(df: DataFrame, partitions: int | None, *keys: str) -> DataFrame:
    """Deals the rows out to ``partitions`` tasks by ``keys``, if a number is given; None leaves them where they are.

    Tables in many splits need none of this. It is for a file with one row group, which is one task however
    large the cluster is: the caller, who knows the files, chooses.
    """
    return df if partitions is None else df.repartition(partitions, *[F.col(k) for k in keys])


def read_requests(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    return _read(spark, path, REQUESTS, format)


def read_responses(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Response rows; gzip-compressed JSON files are read as they are."""
    return _read(spark, path, RESPONSES, format)


def read_attempts(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    return _read(spark, path, ATTEMPTS, format)


def stream_requests(spark: SparkSession, path: str, format: str = "json", **options: str) -> DataFrame:
    return spark.readStream.schema(REQUESTS).format(format).options(**options).load(path)


def read_registry(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """The user registry, a JSON array per file; a path that does not exist is an empty registry.

    A file that does not parse is an error when it is read: no part of a registry may pass for the whole, since an
    empty one can mean that everybody is let in.
    """
    reader = spark.read.schema(USERS).option("multiLine", multi_line).option("mode", "FAILFAST")
    try:
        users = reader.json(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], USERS)
    return users.filter("id is not null")


def read_registry_changes(spark: SparkSession, path: str, format: str = "json") -> DataFrame:
    """Changes to a registry; as for the registry itself, a line that does not parse is an error."""
    return spark.read.schema(CHANGES).format(format).option("mode", "FAILFAST").load(path)


def write_registry(users: DataFrame, snapshot: str) -> None:
    """Writes the whole registry as JSON Lines to a new folder; an existing one is an error.

    Readers switch to a snapshot once its ``_SUCCESS`` file is there, so they never see half of it. Read
    it back with ``read_registry(..., multi_line=False)``.
    """
    users.write.mode("errorifexists").json(snapshot)


def _pointer(spark: SparkSession, folder: str):
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(folder)
    return jvm, path, path.getFileSystem(conf)


def publish_registry(users: DataFrame, folder: str) -> str:
    """Replaces the registry in ``folder`` by ``users`` and returns the new snapshot's name.

    The whole registry goes to a new snapshot first. Then the file ``CURRENT``, which names the snapshot to read, is
    replaced by one rename, so a reader sees the old registry or the new one, and a writer that dies before the
    rename leaves the old one in force. Of two writers the last to rename wins. A rename is atomic on HDFS and local
    file systems; an object store needs a connector whose rename is.
    """
    spark = users.sparkSession
    jvm, root, files = _pointer(spark, folder)
    name = f"snapshot-{uuid.uuid4().hex}"
    write_registry(users, f"{folder}/{name}")
    made = jvm.org.apache.hadoop.fs.Path(root, f".{name}")
    out = files.create(made)
    try:
        out.write(bytearray(name, "ascii"))
    finally:
        out.close()
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(files.makeQualified(made), files.makeQualified(jvm.org.apache.hadoop.fs.Path(root, "CURRENT")), how)
    return name


def current_registry(spark: SparkSession, folder: str) -> DataFrame:
    """The registry that ``publish_registry`` put in force last; an error if there is none."""
    name = _current(spark, folder)
    jvm, root, files = _pointer(spark, folder)
    if not files.exists(jvm.org.apache.hadoop.fs.Path(root, f"{name}/_SUCCESS")):
        raise ValueError(f"{folder}: the snapshot {name} that is in force is not there")
    return read_registry(spark, f"{folder}/{name}", multi_line=False)


def _current(spark: SparkSession, folder: str) -> str:
    jvm, root, files = _pointer(spark, folder)
    taken = files.open(jvm.org.apache.hadoop.fs.Path(root, "CURRENT"))
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(taken, "US-ASCII")
    finally:
        taken.close()


def drop_old_snapshots(spark: SparkSession, folder: str, keep: int = 1) -> int:
    """Deletes snapshots but the one in force and the ``keep`` latest others (readers may still hold those); returns how many.

    Only finished snapshots count, so one that is being written stays."""
    jvm, root, files = _pointer(spark, folder)
    current = _current(spark, folder)
    found = [s for s in files.listStatus(root) if s.getPath().getName().startswith("snapshot-") and s.getPath().getName() != current]
    done = [s for s in found if files.exists(jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
    going = sorted(done, key=lambda s: s.getModificationTime(), reverse=True)[keep:]
    for status in going:
        files.delete(status.getPath(), True)
    return len(going)


def audit_lines(events: DataFrame) -> DataFrame:
    """Events in the form they are written: empty fields null (left out of JSON), a missing ``ts`` filled in."""
    filled = events.withColumn("ts", F.coalesce("ts", rfc3339(F.current_timestamp())))
    kept = filled.select(*[part.split()[0] for part in EVENT.split(", ")])
    return kept.withColumns(
        {
            "items": F.when(F.col("items") != 0, F.col("items")),
            "types": F.when(F.size("types") > 0, F.col("types")),
            **{c: F.nullif(F.col(c), F.lit("")) for c in ("method", "path", "src", "msg")},
        }
    )


def write_audit(events: DataFrame, path: str) -> None:
    """Appends events as JSON Lines."""
    audit_lines(events).write.mode("append").json(path)


def stream_audit(events: DataFrame, path: str) -> DataStreamWriter:
    """A writer (to be started by the caller) that appends streamed events as JSON Lines, each exactly once."""
    return audit_lines(events).writeStream.format("json").outputMode("append").option("path", path)


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENT).json(path)
