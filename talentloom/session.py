"""Session settings the jobs rely on, and the helpers that depend on them."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Bytes of rows in memory per byte of Parquet: 17 for keys with names, more where columns repeat.
FILE_FACTOR, ROWS_PER_FILE_BYTE = "spark.sql.sources.fileCompressionFactor", 32.0
# Adaptive execution compares row bytes with its threshold; as a hash table on the driver they take four times as much.
STATIC, ADAPTIVE, MOST_ADAPTIVE = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold", 1 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def local_session(name: str = "talentloom", cores: str = "*", partitions: int = 8) -> SparkSession:
    """A session for tests and the bench. On a cluster the submitter configures Spark."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_folder(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints.

    Only a local session may go without: its executors share the driver's disk. Any
    other master without a folder is an error, as executors would write to their own.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if configured:
        return configured
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError(f"spark.checkpoint.dir is not set, and {master} needs a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="talentloom-"))
    return spark.sparkContext.getCheckpointDir()


def new_folder(spark: SparkSession) -> str:
    """A folder of its own below the shared one."""
    return f"{shared_folder(spark)}/talentloom-{uuid.uuid4().hex}"


def broadcast_by_rows(spark: SparkSession) -> None:
    """Let joins broadcast what is small in memory, not what is small on disk.

    Spark guesses the size of a scan from its file, but rows take tens of times as much once
    read: files below the broadcast threshold filled the driver with millions of rows. The
    guess is raised accordingly for this session, unless the submitter has set it. Adaptive
    execution still broadcasts whatever proves small when its rows are counted, up to 1 MB
    of them: a query has dozens of joins, and their tables lie on the driver together. A
    lower threshold of the submitter, or any they set for adaptive execution, stays.
    """
    if float(spark.conf.get(FILE_FACTOR, "1.0")) == 1.0:
        spark.conf.set(FILE_FACTOR, str(ROWS_PER_FILE_BYTE))
    if spark.conf.get(ADAPTIVE, None) is None and _bytes(spark.conf.get(STATIC)) > MOST_ADAPTIVE:
        spark.conf.set(ADAPTIVE, str(MOST_ADAPTIVE))


def _bytes(size: str) -> int:
    """The bytes of a size as Spark writes it: 10485760b, 10m, 10MB."""
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)b?", size.strip().lower()).groups()
    return int(number) << 10 * " kmgtp".index(unit or " ")


def materialise(df: DataFrame, codec: str | None = None) -> DataFrame:
    """Cut lineage: write the rows to the shared folder and read them back.

    Losing executors costs nothing afterwards, later plans stay short, and file
    sizes tell Spark whether a table is small enough to broadcast. Shuffle files of the
    write go with its end, as nothing reads them again.
    """
    spark = df.sparkSession
    path, before = new_folder(spark), spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path, compression=codec)
    finally:
        spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(written: DataFrame) -> None:
    """Delete the folder of a table that materialise wrote, once everything read from it has
    been written in turn: lost executors then go back to those later tables."""
    spark = written.sparkSession
    for folder in {file.rsplit("/", 1)[0] for file in written.inputFiles()}:
        if folder.rsplit("/", 1)[1].startswith("talentloom-"):
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def default_salts(df: DataFrame) -> int:
    """How many ways a hot key is split: a share of the shuffle width."""
    return max(2, min(64, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) // 4))


def salt(*columns: Column | str, salts: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(salts)).cast("int")


def salted_join(
    many: DataFrame,
    few: DataFrame,
    keys: list[str],
    spread_by: list[str],
    how: str = "inner",
    salts: int | None = None,
) -> DataFrame:
    """Equi-join where one key of `many` may hold a large share of its rows.

    `many` is spread over `salts` sub-keys by the columns of `spread_by`; `few`,
    which has a bounded number of rows per key, is repeated once per sub-key.
    """
    n = salts or default_salts(many)
    left = many.withColumn("_salt", salt(*spread_by, salts=n))
    right = few.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return left.join(right, [*keys, "_salt"], how).drop("_salt")


def hot_keys(counted: DataFrame, key: str, rows: int = 100_000) -> DataFrame:
    """(key, _copies): keys of `counted` (key, n) with more than `rows` rows, and how many ways to split them."""
    return counted.where(F.col("n") > rows).select(key, F.least(F.ceil(F.col("n") / rows), F.lit(256)).cast("int").alias("_copies"))


def hot_join(many: DataFrame, few: DataFrame, key: str, hot: DataFrame, spread_by: list[str], how: str = "inner") -> DataFrame:
    """Equi-join in which only the keys of `hot` are split: rows of `many` over the copies of
    the key, rows of `few` repeated once per copy. All other keys meet once, as usual."""
    copies = F.coalesce("_copies", F.lit(1))
    left = many.join(hot, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*spread_by), copies).cast("int")).drop("_copies")
    right = few.join(hot, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), copies - 1))).drop("_copies")
    return left.join(right, [key, "_salt"], how).drop("_salt")
