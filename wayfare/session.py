"""Session settings the jobs rely on, and the shared folder they may write to."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession

# Shuffle data that adaptive execution merges into one task. Joins and sorts hold it some five
# times larger, so that what fits four tasks of a small executor spills with more.
MERGED_BYTES = 32 * 1024**2

SETTINGS = {
    # Day boundaries must not depend on where an executor runs.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(MERGED_BYTES),
    # Second line of defence after the explicit salting in operators.skew.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Where the measured build side of every partition is this small, hash instead of
    # sorting both sides.
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": "64MB",
}


# Shuffle data one task should have to hold, and how much larger rows in a shuffle are
# than the same rows in compressed files.
TASK_BYTES = 128 * 1024**2
SHUFFLE_EXPANSION = 2

WIDTH = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
LARGE_INPUT = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(MERGED_BYTES),
    "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold": str(TASK_BYTES),
}

# settings that each session had before any data set widened them
_before: dict[str, dict[str, str | None]] = {}


def shuffle_width(spark: SparkSession) -> int:
    """Partitions a shuffle starts with, before small ones are merged."""
    return int(spark.conf.get(WIDTH, None) or spark.conf.get("spark.sql.shuffle.partitions"))


def scan_bytes(df: DataFrame) -> int:
    """Bytes that the scans of ``df`` read, from the file listing: files by share of columns.

    Spark estimates this while planning; no file is opened.
    """

    def alone(node) -> bool:
        return node.children().isEmpty() or (
            node.children().size() == 1 and alone(node.children().head())
        )

    def read(node) -> int:
        if node.children().isEmpty() or (node.nodeName() == "Project" and alone(node)):
            return int(node.stats().sizeInBytes())
        children = node.children()
        return sum(read(children.apply(k)) for k in range(children.size()))

    return read(df._jdf.queryExecution().optimizedPlan())


def file_bytes(df: DataFrame) -> int | None:
    """``scan_bytes`` of a plan that reads files only; None where other rows come in, whose
    size Spark does not know."""

    def leaves(node) -> list:
        children = node.children()
        below = [leaf for k in range(children.size()) for leaf in leaves(children.apply(k))]
        return below or [node]

    plan = df._jdf.queryExecution().optimizedPlan()
    known = all(leaf.nodeName().startswith("LogicalRelation") for leaf in leaves(plan))
    return scan_bytes(df) if known else None


def is_plain_scan(df: DataFrame) -> bool:
    """Is ``df`` a table of parquet files as it is, or some of its columns under their names?"""
    plan = df._jdf.queryExecution().optimizedPlan()
    if plan.nodeName() == "Project" and set(df.columns) <= set(_names(plan.child())):
        plan = plan.child()
    return plan.nodeName().startswith("LogicalRelation") and "parquet" in plan.simpleString(1)


def _names(plan) -> list[str]:
    return [plan.output().apply(k).name() for k in range(plan.output().size())]


def size_shuffles(spark: SparkSession, nbytes: int, width: int | None = None) -> int:
    """Make shuffles wide enough for ``nbytes`` of input, or ``width`` partitions wide.

    Adaptive execution merges partitions that turn out small but cannot split the rest, so
    the starting number has to suit the largest shuffle: all of the input. There is no upper
    limit. Never narrower than the session was configured, and what an earlier, larger data
    set needed is taken back.
    """
    before = _before.setdefault(
        spark._jsparkSession.sessionUUID(),
        {key: spark.conf.get(key, None) for key in (WIDTH, *LARGE_INPUT)},
    )
    for key, value in before.items():
        if value is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, value)
    wanted = width or nbytes * SHUFFLE_EXPANSION // TASK_BYTES
    if wanted > shuffle_width(spark):
        for key, value in LARGE_INPUT.items():
            spark.conf.set(key, value)
        spark.conf.set(WIDTH, str(wanted))
    return shuffle_width(spark)


def configure(spark: SparkSession) -> SparkSession:
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(
    cores: str = "*",
    shuffle_partitions: int = 8,
    memory: str = "8g",
    shared: str | None = None,
) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("wayfare")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    )
    if shared:
        builder = builder.config("spark.checkpoint.dir", shared)
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return configure(spark)


def file_system(spark: SparkSession, folder: str):
    """Hadoop's file system of a folder, and the folder's path in it."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def write_text(spark: SparkSession, name: str, text: str) -> None:
    """Write a small file, from the driver."""
    files, path = file_system(spark, name)
    out = files.create(path, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def read_text(spark: SparkSession, name: str) -> str | None:
    """Read a small file, without a job; None if there is none."""
    files, path = file_system(spark, name)
    if not files.exists(path):
        return None
    source = files.open(path)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(source, "UTF-8")
    finally:
        source.close()


def shared_folder(spark: SparkSession) -> str:
    """Folder for written intermediate tables, visible to every executor.

    Taken from ``spark.checkpoint.dir``. Only a local-mode session, whose driver is its
    only machine, may fall back to a fresh temporary folder.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    return tempfile.mkdtemp(prefix="wayfare-")
