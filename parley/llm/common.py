"""Helpers shared by the operators of this package."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of anything but ASCII blanks.
WORD = r"[^\x20\x09-\x0D]+"
#: Words per shingle, and the share of shingles that makes texts near-duplicates (as a fraction of 100).
SHINGLE_WORDS = 5
SIMILAR_PERCENT = 75

#: Setting of Spark 4.1 under which a job's shuffle files go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Share of the driver's heap in use from which ``tidy`` has it collected.
GARBAGE_SHARE = 0.3
#: Folders of ``shared_dir``.
WRITTEN = re.compile(r"-[0-9a-f]{32}$")

MIX = tuple(int(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9,
                             0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder for intermediate tables under the shared folder of ``spark.checkpoint.dir``."""
    from parley.session import ensure_checkpoint_dir

    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def tidy(spark: SparkSession) -> None:
    """Have the driver collect its garbage once that fills more than ``GARBAGE_SHARE`` of its heap.

    Plans, filters sent with tasks and what they were made from die with their job, but a heap that has room grows before it
    is collected and keeps what it took; a job of many steps would hold the whole of it beside what the driver needs
    outside the heap. With the garbage go the broadcasts and shuffles that nothing refers to any more.
    """
    jvm = spark.sparkContext._jvm
    runtime = jvm.java.lang.Runtime.getRuntime()
    if runtime.totalMemory() - runtime.freeMemory() > GARBAGE_SHARE * runtime.maxMemory():
        jvm.java.lang.System.gc()


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back (cuts lineage; survives lost executors).

    Once the table is there, nothing reads the shuffle files behind it; Spark 4.1 is told to delete them with the job, where
    they would else stay until the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    tidy(spark)
    path, before = shared_dir(spark, name), spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def removed(*tables: DataFrame) -> None:
    """Delete the folders of tables that ``written`` made; nothing that is still to run may read them."""
    for df in tables:
        jvm, conf = df.sparkSession.sparkContext._jvm, df.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if WRITTEN.search(folder):
                path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
                path.getFileSystem(conf).delete(path, True)


def mixed(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes in place so that every output bit depends on every input bit."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(text: str | None) -> np.ndarray:
    """64-bit hashes of the words of a text, with A-Z lower-cased (empty for null)."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), dtype=np.uint64, count=len(words))


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` words, in text order (empty if there are fewer words)."""
    if len(words) < n:
        return np.empty(0, dtype=np.uint64)
    size = len(words) - n + 1
    total = np.full(size, n, dtype=np.uint64)
    for j in range(n):
        total += words[j:j + size] * np.uint64(MIX[j])
        if j % 2:
            total ^= total >> np.uint64(32)
    return mixed(total)


def shingle_set(text: str | None, n: int = SHINGLE_WORDS) -> np.ndarray:
    """Sorted distinct ``n``-word shingle hashes; with fewer words the whole sequence is the one shingle."""
    words = word_hashes(text)
    return np.unique(ngram_hashes(words, n if len(words) >= n else max(len(words), 1)))
