"""A table on files that takes upserts by key.

Rows lie in hash buckets of their key. An upsert reads the buckets that its keys
fall into, merges them with the new rows, and writes them to a new folder; all
other buckets stay as they are. Then one file is added to the manifest, which
names the folder of every rewritten bucket. The table is what the manifest says,
so readers see the old rows until that file is there, and a run that fails before
leaves nothing but a folder that nobody reads; it can be repeated. All files are
written and read by Spark, on any file system. One writer at a time.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MANIFEST = "version bigint, bucket int, folder string, n_rows bigint, n_buckets int, keys array<string>, order_by array<string>, table_schema string"


def _manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).json(f"{path}/manifest")


def create_table(spark: SparkSession, path: str, schema: StructType, key_cols: list[str], order_cols: list[str], n_buckets: int = 64) -> None:
    """An empty table: its schema, key, the columns that say which row of a key is the latest, and its number of buckets."""
    missing = [c for c in [*key_cols, *order_cols] if c not in schema.names]
    if missing or not key_cols or {"bucket", "_new"} & set(schema.names):
        raise ValueError(f"key and order columns must be in the schema, 'bucket' and '_new' must not; not there: {missing}")
    row = (0, None, None, 0, n_buckets, key_cols, order_cols, schema.json())
    spark.createDataFrame([row], _MANIFEST).coalesce(1).write.mode("errorifexists").json(f"{path}/manifest")


class _Table:
    """What the manifest says: the layout, and the folder of each bucket that has rows."""

    def __init__(self, spark: SparkSession, path: str):
        import json

        self.spark, self.path = spark, path.rstrip("/")
        log = _manifest(spark, self.path)
        head = log.where("version = 0").first()
        self.keys, self.order, self.n_buckets = list(head["keys"]), list(head["order_by"]), head["n_buckets"]
        self.schema = StructType.fromJson(json.loads(head["table_schema"]))
        latest = log.where("bucket IS NOT NULL").groupBy("bucket").agg(F.max_by("folder", "version").alias("folder"))
        self.folders = {r["bucket"]: r["folder"] for r in latest.collect()}  # one entry per bucket
        self.version = log.agg(F.max("version")).first()[0]

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.n_buckets)).cast("int")

    def rows(self, buckets=None) -> DataFrame:
        paths = [f"{self.path}/data/{f}/bucket={b}" for b, f in sorted(self.folders.items()) if buckets is None or b in buckets]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The rows as of the last upsert that ended."""
    return _Table(spark, path).rows()


def read_keys(spark: SparkSession, path: str, keys: DataFrame) -> DataFrame:
    """The rows of some keys, from their buckets alone."""
    t = _Table(spark, path)
    buckets = {r[0] for r in keys.select(t.bucket()).distinct().collect()}  # at most one per bucket
    return t.rows(buckets).join(keys.select(*t.keys).distinct(), t.keys, "left_semi")


def upsert(rows: DataFrame, path: str) -> int:
    """Merge ``rows`` into the table at ``path`` and return its version.

    Of the rows of a key, old and new, the one latest by the table's order columns stays (a new row where they are equal),
    so repeated and late batches do no harm. Keys with a NULL are keys like others. No rows change nothing.
    """
    from parley.operators.runs import upsert_latest

    spark = rows.sparkSession
    t = _Table(spark, path)
    if [(f.name, f.dataType) for f in rows.schema] != [(f.name, f.dataType) for f in t.schema]:
        raise ValueError(f"columns differ from the table's: {rows.schema.simpleString()} against {t.schema.simpleString()}")
    latest = upsert_latest(rows.withColumn("_new", F.lit(1)), t.keys, [*t.order, "_new"]).withColumn("bucket", t.bucket())
    touched = {r[0] for r in latest.select("bucket").distinct().collect()}  # at most one per bucket
    if not touched:
        return t.version
    old = t.rows(touched).withColumn("_new", F.lit(0)).withColumn("bucket", t.bucket())
    merged = upsert_latest(old.unionByName(latest.select(old.columns)), ["bucket", *t.keys], [*t.order, "_new"])
    folder = f"v{t.version + 1}-{uuid.uuid4().hex}"
    merged.repartition("bucket").select("bucket", *t.schema.names).write.partitionBy("bucket").parquet(f"{t.path}/data/{folder}")
    counts = spark.read.parquet(f"{t.path}/data/{folder}").groupBy("bucket").agg(F.count(F.lit(1)).alias("n_rows"))
    entry = counts.select(F.lit(t.version + 1).cast("bigint").alias("version"), F.col("bucket").cast("int"), F.lit(folder).alias("folder"), "n_rows")
    entry.coalesce(1).write.mode("append").json(f"{t.path}/manifest")  # one file: all of the new buckets show up, or none
    return t.version + 1
