"""Helpers shared by the corpus operators: column hygiene, lineage cuts, Arrow slicing."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Bytes of text handled at once inside a Python worker; one longer document is one slice.
SLICE_BYTES = 1 << 20


#: Bytes of one Arrow batch on its way to a worker.  Spark's own bound lets 10,000 texts, a whole partition, be one batch, which
#: executor and worker each hold at once, beside the copies made while it grows.
BATCH_BYTES = 4 << 20
_BATCH_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """From now on texts of this session go to workers about BATCH_BYTES at a time; a smaller bound in bytes stays."""
    have = spark.conf.get(_BATCH_CONF).removesuffix("b")  # Spark's own reads 67108864b
    if not have.isdigit() or not 0 < int(have) <= BATCH_BYTES:
        spark.conf.set(_BATCH_CONF, str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **kinds: str) -> DataFrame:
    """Keep only the named columns, cast; other columns, whatever their names, are left behind.

    A name written in another case is the same column; a missing one is null.
    """
    have: dict[str, str] = {}
    for c in df.columns:
        have.setdefault(c.lower(), c)
        have[c] = c
    out = []
    for name, kind in kinds.items():
        src = have.get(name, have.get(name.lower()))
        col = F.lit(None) if src is None else df[f"`{src}`"]
        out.append(col.cast(kind).alias(name))
    return df.select(*out)


def documents(df: DataFrame) -> DataFrame:
    return pick(df, doc_id="bigint", text="string")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, or one of our own where that is unset (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = tempfile.mkdtemp(prefix="jatoba-")
    spark.conf.set("spark.checkpoint.dir", own)
    return own


_stashed: dict[str, SparkSession] = {}


def _delete(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _sweep() -> None:
    for path, spark in _stashed.items():
        try:
            _delete(spark, path)
        except Exception:  # the session may have ended; the cluster's own clean-up then applies
            continue


def stash(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared folder and read back.  A lost executor costs nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _stashed:
        atexit.register(_sweep)
    _stashed[path] = spark
    back = spark.read.schema(df.schema).parquet(path)
    back._stash = path
    return back


#: Rows of a few numbers and hashes each that are broadcast at most (about 10 MB); more are joined by a shuffle.
BROADCAST_ROWS = 250_000


def small(stored: DataFrame) -> DataFrame:
    """A stored table of narrow rows, to be broadcast if its rows, which are counted, are few enough."""
    return F.broadcast(stored) if stored.count() <= BROADCAST_ROWS else stored


def discard(*tables: DataFrame | None) -> None:
    """Delete stashed tables that nothing reads any more: whatever was made of them is itself stored."""
    for t in tables:
        path = getattr(t, "_stash", None)
        if path in _stashed:
            _delete(_stashed.pop(path), path)


_caches: dict[str, dict] = {}


def cache(owner: str) -> dict:
    """A dictionary that lives as long as tasks of one operator follow one another in a worker."""
    return _caches.setdefault(owner, {})


def claim(owner: str = "") -> None:
    """A task of ``owner`` begins: what other operators have cached in this worker goes."""
    others = [c for name, c in _caches.items() if name != owner and c]
    for c in others:
        c.clear()
    if others:
        trim()


def trim() -> None:
    """Give memory that a task no longer uses back to the system: workers live on for tasks of other stages."""
    pa.default_memory_pool().release_unused()
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES, owner: str = "") -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text of each slice is about ``limit`` bytes, or one row."""
    import pyarrow.compute as pc

    claim(owner)

    for batch in batches:
        if batch.num_rows == 0:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()
        start = total = 0
        for i, n in enumerate(sizes):
            if total and total + n > limit:
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
    trim()
