"""What several operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.sources import session
from tidewire.sources.session import shared_folder

#: Characters between words: space and the controls from tab to carriage return.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bytes of an Arrow batch that goes to a Python worker, at most about.
BATCH_BYTES = 1 << 20
#: Names of up to this many files are broadcast.
FILES = 1_000_000
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def shipped(spark: SparkSession) -> SparkSession:
    """Sends this package to the executors once a session, and bounds the bytes of the Arrow batches that they get, unless
    the session has set a bound itself."""
    if spark.conf.get(_BATCH) == "67108864b":  # Spark's own default
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    return session.shipped(spark)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return shipped(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str = "part") -> DataFrame:
    """``df`` written to the shared folder and read back: cuts the lineage, survives lost
    executors, and lets several readers use one computation."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidewire_path = path
    return out


def removed(df: DataFrame) -> None:
    """Deletes a table made by ``written`` once nothing reads it any more."""
    spark, path = df.sparkSession, df._tidewire_path
    jvm = spark.sparkContext._jvm
    to = jvm.org.apache.hadoop.fs.Path(path)
    to.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(to, True)


#: Nodes of a plan under which each row is one row of a file.
_PLAIN = {"Project", "Filter", "SubqueryAlias", "View"}


def _of_files(df: DataFrame) -> bool:
    """Whether each row of ``df`` is a row of a file of its own: a scan under filters and projections alone. Hidden columns
    pass through generators, joins and unions too, where several rows would share a place."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in _PLAIN:
        node = node.children().head()
    return node.nodeName() == "LogicalRelation"


def numbered(df: DataFrame, to: str) -> DataFrame:
    """``df`` with a number for each row in the column ``to``, the same in all readings. Rows of a file have the place in
    their file and the files before it, so nothing is copied; other rows (behind a generator, join or union) are written first."""
    try:
        files = df.select(F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at")) if _of_files(df) else None
    except AnalysisException:
        files = None
    if files is None:
        return written(df.withColumn(to, F.monotonically_increasing_id()), "numbered")
    # one row a file
    rows = written(files.groupBy("_file").agg((F.max("_at") + 1).alias("_n")), "files")
    before = Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(rows.select(F.col("_file").alias("_of"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base")), "bases")
    removed(rows)
    found = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_at"))
    return found.join(checked(bases, FILES), F.col("_file") == F.col("_of")).select(*df.columns, (F.col("_base") + F.col("_at")).alias(to))


#: A key that more than one in so many rows have is joined in parts; so many keys can do so at most.
HOT_PARTS = 1_000


def salted(rows: DataFrame, keyed: DataFrame, key: str, n: str) -> DataFrame:
    """``rows`` joined with ``keyed``, a written table of one row a key with the number ``n`` of its rows. Rows of a key that
    holds a large share are dealt over parts, to which its row of ``keyed`` is copied; the list of such keys has at most
    ``HOT_PARTS`` rows and is broadcast."""
    total = keyed.agg(F.sum(n)).first()[0] or 0
    most = max(1, -(-total // HOT_PARTS))
    parts = F.ceil(F.col(n) / most).cast("int")
    hot = keyed.filter(F.col(n) > most).select(F.col(key).alias("_hot"), parts.alias("_parts"))
    dealt = rows.join(F.broadcast(hot), F.col(key) == F.col("_hot"), "left").withColumn("_part", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_parts")), F.lit(0)).cast("int")).drop("_hot", "_parts")
    copied = keyed.select("*", F.explode(F.sequence(F.lit(0), F.greatest(parts, F.lit(1)) - 1)).alias("_part"))
    return dealt.join(copied, [key, "_part"]).drop("_part")


def checked(df: DataFrame, most: int) -> DataFrame:
    """``df`` (written, narrow rows) as a side to broadcast if it has at most ``most`` rows, else as it is."""
    return F.broadcast(df) if df.count() <= most else df


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words_of(text: Column, pattern: str = WORD) -> Column:
    """All words of a text, in order; null counts as empty."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(0))


def quantile_bounds(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts`` - 1 rising values that split ``key`` into ranges of near-equal row counts."""
    if parts < 2:
        return []
    at = [i / parts for i in range(1, parts)]
    row = df.agg(F.percentile_approx(key, at, 10 * parts).alias("q")).first()
    return sorted(set(row.q or []))


def range_of(key: Column, bounds: list[int]) -> Column:
    """The number of the range that ``key`` falls into; null goes to the first."""
    if not bounds:
        return F.lit(0)
    held = F.lit(bounds).cast("array<bigint>")
    return F.coalesce(F.size(F.filter(held, lambda b: b <= key)), F.lit(0))
