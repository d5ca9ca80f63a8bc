"""Helpers that the training-data operators share."""

from __future__ import annotations

import atexit
import os
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII blanks: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = r"[\x20\x09-\x0D]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_written: list[tuple[SparkSession, str]] = []
_recording = threading.local()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    ``spark.checkpoint.dir`` names it.  Only where the session leaves that unset
    (tests on one machine) a temporary folder takes its place.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = "file://" + tempfile.mkdtemp(prefix="sluice-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    This cuts lineage: whatever executor is lost afterwards, later stages read
    files, and nothing above is computed a second time.  The write's own shuffle
    files go as soon as it is done.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/sluice/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    _written.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._sluice_path = path
    for tables in getattr(_recording, "open", ()):
        tables.append(out)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of ``materialize`` that nothing reads any more."""
    for df in tables:
        spark, path = df.sparkSession, df._sluice_path
        if (spark, path) in _written:
            _delete(spark, path)
            _written.remove((spark, path))


@contextmanager
def recorded() -> Iterator[list[DataFrame]]:
    """The tables that ``materialize`` writes meanwhile in this thread."""
    tables: list[DataFrame] = []
    _recording.open = [*getattr(_recording, "open", ()), tables]
    try:
        yield tables
    finally:
        _recording.open = _recording.open[:-1]


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


@atexit.register
def drop_written() -> None:
    """Remove the tables that ``materialize`` wrote, while the session lives."""
    for spark, path in _written:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001 - the session may have ended already
            pass
    _written.clear()


def ship(spark: SparkSession) -> None:
    """Make this package importable by the executors' Python.

    Does nothing where they see the source folder already; else the package goes
    to them as a zip file through Spark.
    """
    root = Path(__file__).resolve().parents[2]
    seen = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(":") if p}
    if str(root) in seen or os.path.realpath(os.getcwd()) == str(root) or getattr(spark, "_sluice_shipped", False):
        return
    to = Path(tempfile.mkdtemp(prefix="sluice-")) / "sluice.zip"
    with zipfile.ZipFile(to, "w") as z:
        for p in (root / "sluice").rglob("*.py"):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(to))
    spark._sluice_shipped = True


def words(text):
    """Column: the words of ``text``, split at ASCII blanks; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def maybe_in(bits: DataFrame, bit: Column, size: int) -> Column:
    """Column: whether ``bit`` is among the numbers ``b`` (1 .. ``size``) of a table; the bitmap's size doesn't depend on the table's."""
    parts = bits.groupBy(F.bitmap_bucket_number("b").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("m")).collect()
    width = 4096  # bytes of each part; parts count from 1
    whole = bytearray(size // 8)
    for r in parts:
        whole[(r["k"] - 1) * width : r["k"] * width] = r["m"]
    place = (F.bitmap_bucket_number(bit) - 1) * width + F.floor(F.bitmap_bit_position(bit) / 8) + 1
    byte = F.conv(F.hex(F.call_function("substring", F.lit(whole), place.cast("int"), F.lit(1))), 16, 10).cast("int")
    return byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (F.bitmap_bit_position(bit) % 8).cast("int"))) != 0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def file_of(name: str) -> str:
    """Where the public tokenizer file ``name`` lies."""
    import public_tokenizers

    return public_tokenizers.path(name)
