"""What the operators of this subpackage share: staging in the shared folder, row keys, small expressions."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Used only where the session names no folder (tests, local runs).
LOCAL_SHARED = "/tmp/checkpoints"

#: Characters that separate words, as in ``[^\x20\x09-\x0D]+``.
SPACES = " \t\n\x0b\x0c\r"
WORD_BREAK = r"[\x20\x09-\x0D]+"

_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir of the session, else, on one machine, a local one.

    Executors on other machines couldn't read what is staged in a local folder, so a cluster must name one.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = LOCAL_SHARED
        if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
            spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own below the shared folder and the application's id, deleted when the driver's Python ends.

    What a killed driver leaves is below its application's id, so it can be told from what still is in use.
    """
    path = f"{shared_folder(spark)}/scrivana/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    atexit.register(delete, spark, path)
    return path


def delete(spark: SparkSession, path: str) -> None:
    """Remove a staged folder; a session that has already ended is left alone."""
    with contextlib.suppress(Exception):
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def staged(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_folder(spark, name)
    df.write.parquet(path)
    found = spark.read.schema(df.schema).parquet(path)
    found._staged_in = path
    return found


def forget(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete staged tables that no later step reads, so that a long session's folder doesn't grow."""
    for table in tables:
        path = table.__dict__.get("_staged_in")
        if path:
            delete(spark, path)


def is_bare_scan(docs: DataFrame) -> bool:
    """Whether each row of docs is one row of a Parquet file: a scan with filters and projections only.

    Above a join, an explode, a union or a sample several rows may share a file's row, or which rows there are may
    change from one evaluation to the next.
    """
    plan = docs._jdf.queryExecution().analyzed()
    if "_metadata" in docs.columns or "_metadata" not in plan.metadataOutput().toString() or not plan.deterministic():
        return False
    if "row_index" not in docs.select("_metadata").schema["_metadata"].dataType.names:
        return False
    while plan.nodeName() in ("Project", "Filter", "SubqueryAlias"):
        plan = plan.children().head()
    return plan.children().isEmpty()


def packed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs as (loc, row): a content locator and the whole row, so that no column name can clash.

    The locator is (hash of the file's path, number of the row in it). Rows that aren't read straight from files
    (see is_bare_scan) are written to the shared folder first, which gives each of them a place of its own.
    """
    whole = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), *([F.col("_metadata.file_path").alias("p"), F.col("_metadata.row_index").alias("i")] if (bare := is_bare_scan(docs)) else []))
    if not bare:
        whole = staged(spark, whole, "rows").select("row", F.col("_metadata.file_path").alias("p"), F.col("_metadata.row_index").alias("i"))
    return whole.select(F.struct(F.xxhash64("p").alias("file"), F.col("i").alias("at")).alias("loc"), "row")


#: The locator's type, for functions that name their columns' types.
LOC = "struct<file:bigint,at:bigint>"


def heavy(spark: SparkSession, df: DataFrame, key: str, width: int = 1024, most: int = 1_000_000) -> DataFrame:
    """(key, salts): the values of key that hold over `width` rows, and over one in `most` of all, with a number of salts.

    That makes `most` rows at most, whatever the size of df, so the table can be broadcast. Written once.
    """
    least = max(width, df.count() // most)
    counts = df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > least)
    return staged(spark, counts.select(key, F.ceil(F.col("n") / least).cast("int").alias("salts")), "heavy")


def salted(df: DataFrame, key: str, hot: DataFrame, by: str) -> DataFrame:
    """df with salt: rows of a heavy key are dealt over its salts by a hash of `by`."""
    return df.join(F.broadcast(hot), key, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64(by), F.col("salts")).cast("int"), F.lit(0))).drop("salts")


def for_salts(df: DataFrame, key: str, hot: DataFrame) -> DataFrame:
    """df (a row for each key) with a row for each salt of its key, to be joined on (key, salt)."""
    return df.join(F.broadcast(hot), key, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")


def texts(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """(loc, doc_id, text) of documents; a null text counts as empty."""
    return packed(spark, docs).select("loc", F.col("row.doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("row.text"), F.lit("")).alias("text"))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; every other character stays."""
    return F.translate(text, _UPPER, _UPPER.lower())


def let(value: Column, body) -> Column:
    """Bind value once for use inside body, also where body has lambdas that would evaluate it again and again."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, as an array; empty for null or blank texts."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACES))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WORD_BREAK, -1))


def lean(work):
    """work (a function of an iterator of batches) that gives freed memory back to the system when a task ends.

    Spark keeps Python workers for later tasks and stages, and their allocators keep what they have had.
    """

    def run(batches):
        try:
            yield from work(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # where the C library isn't glibc
                ctypes.CDLL(None).malloc_trim(0)

    return run


def conf_during(spark: SparkSession, **values: str):
    """Set session options for the length of a with block, then put back what was there."""

    @contextlib.contextmanager
    def scope():
        before = {k: spark.conf.get(k, None) for k in values}
        for k, v in values.items():
            spark.conf.set(k, v)
        try:
            yield
        finally:
            for k, v in before.items():
                spark.conf.unset(k) if v is None else spark.conf.set(k, v)

    return scope()
