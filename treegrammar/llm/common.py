"""What the operators share: the cluster's shared folder, written tables, file access and text columns."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are maximal runs of bytes other than space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where that is unset and the master is local (local-cluster has workers with folders of their own, but one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="treegrammar-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_made: list[str] = []  # paths of this process that have not been deleted


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; forget_all() deletes it at the latest."""
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def cut(spark: SparkSession, df: DataFrame, name: str) -> DataFrame:
    """df as a written table: its lineage ends there and a lost executor costs no recomputation."""
    path = scratch(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(*tables: DataFrame | str) -> None:
    """Deletes written tables (or paths) that nothing will read again."""
    spark = SparkSession.active()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    for t in tables:
        for p in {t} if isinstance(t, str) else {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(conf).delete(path, True)
            if p in _made:
                _made.remove(p)


def forget_all() -> None:
    """Deletes every written table and file of this process: for a long session, once the results of its queries have been stored elsewhere."""
    forget(*_made)


class Buckets:
    """Tables in the shared folder, bucketed alike by one column: joins and groups between them by that column move no rows."""

    def __init__(self, spark: SparkSession, by: str):
        self.spark, self.by, self.n, self.made = spark, by, partitions(spark), []

    def put(self, df: DataFrame, dealt: bool = True) -> DataFrame:
        """df as a written table. dealt: rows go to one file a bucket; else each task writes its own files, which moves no rows."""
        name, path = f"bucketed_{uuid.uuid4().hex}", scratch(self.spark, "bucketed")
        df = df.repartition(self.n, self.by) if dealt else df
        df.write.option("path", path).option("compression", "zstd").bucketBy(self.n, self.by).saveAsTable(name)
        self.made.append((name, path))
        return self.spark.table(name)

    def drop(self, start: int = 0, end: int | None = None) -> None:
        """Drops the tables of this range in the order of their making; what reads them must have been written by then."""
        for name, path in self.made[start:end]:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            forget(path)
        del self.made[start:end]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def quoted(name: str) -> str:
    """A column's name where a path of fields is read."""
    return "`" + name.replace("`", "``") + "`"


def numbered(df: DataFrame) -> DataFrame:
    """df with columns c0, c1 ... in place of names that functions over batches may not take; toDF(*df.columns) undoes it."""
    return df.toDF(*(f"c{i}" for i in range(len(df.columns))))


def ascii_lower(c: Column) -> Column:
    """A-Z only; other letters keep their case."""
    return F.translate(c, UPPER, LOWER)


def held(doc_id: Column, modulus: int, rest: int) -> Column:
    """crc32 of the id as text leaves this remainder; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % modulus == rest, F.lit(False))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """pyarrow's file system and the path in it, for any URI that pyarrow knows."""
    return pafs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (pafs.LocalFileSystem(), uri)


def put_file(uri: str, pieces) -> int:
    """Writes the byte pieces under another name and renames it, so that a repeated or lost task attempt never leaves half a file. Returns its length."""
    where, path = filesystem(uri)
    part = f"{path}.{uuid.uuid4().hex}.part"
    n = 0
    with where.open_output_stream(part) as out:
        for p in pieces:
            out.write(p)
            n += len(p)
    where.move(part, path)
    return n


def make_dir(uri: str) -> None:
    where, path = filesystem(uri)
    where.create_dir(path, recursive=True)


def give_back() -> None:
    """Returns memory that a worker has freed to the machine, so that one stage's peak isn't held through the next."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # another C library
        ctypes.CDLL(None).malloc_trim(0)


def batch(schema: pa.Schema, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if not isinstance(columns[f.name], pa.Array) else columns[f.name] for f in schema], schema=schema)
