"""Shared pieces: reading tables, tables kept in the shared folder, word splitting."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Words are what ASCII white space separates, everywhere in this subpackage.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset a folder of our own is set, which only a local master may use.
    """
    conf = spark.sparkContext.getConf()
    base = conf.get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if conf.get("spark.master", "local").partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    own = tempfile.mkdtemp(prefix="gradus-")
    atexit.register(shutil.rmtree, own, ignore_errors=True)
    spark.conf.set("spark.checkpoint.dir", f"file://{own}")
    return f"file://{own}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, so that a lost
    executor costs a read, and lets a later join see plain exchanges, which AQE can split."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/kept/{name}-{uuid.uuid4().hex}"
    # Nothing reads the shuffle files of a finished write; else they stay until the driver collects its garbage.
    before = spark.conf.get(_CLEAN, "false")
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEAN, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_at = path
    return out


def drop_kept(*frames: DataFrame) -> None:
    """Delete tables of keep() that no later plan reads."""
    for df in frames:
        if path := getattr(df, "_kept_at", None):
            spark = df.sparkSession
            jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def small(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """Batches of at most so many rows, so that few texts at a time become Python objects; what the
    allocators hold on to goes back to the system when a task ends, as workers outlive it."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()
    try:
        import ctypes

        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass  # another C library


def filesystem(path: str):
    """The store of a path and the path within it; bare paths are local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def located(df: DataFrame) -> DataFrame:
    """df behind two columns that name each of its rows: a hash of its file, and its place in it.

    A table read from Parquet is taken as it is, so its rows keep these names however often it
    is read. Anything else is written to the shared folder first. The columns of df follow as c0,
    c1, ..., so that no name can clash.
    """
    relation = df._jdf.queryExecution().analyzed()
    if relation.getClass().getSimpleName() != "LogicalRelation" or "parquet" not in relation.relation().toString().lower():
        df = keep(df.toDF(*(f"c{i}" for i in range(len(df.columns)))), "located")
    where = df.metadataColumn("_metadata")
    plain = df.select(F.xxhash64(where["file_path"]), where["row_index"], "*")
    return plain.toDF("file", "at", *(f"c{i}" for i in range(len(df.columns))))


class Marks:
    """Long values of some rows of a located table, listed by file in the shared folder.

    A task that reads the table again fetches the lists of its own files only, so nothing
    is broadcast and no text moves. Lists of many files share a folder; a folder has about
    rows_per_part rows.
    """

    def __init__(self, marked: DataFrame, name: str, rows_per_part: int = 500_000):
        """marked: file, at and value, all long, at most one row for each (file, at)."""
        spark = marked.sparkSession
        held = keep(marked.select("file", "at", "value"), name)
        self.parts = max(1, min(1 << 16, -(-held.count() // rows_per_part)))
        self._frame = spark.range(0)
        self.path = f"{shared_dir(spark)}/kept/{name}-{uuid.uuid4().hex}"
        part = F.pmod("file", F.lit(self.parts)).alias("part")
        held.select("file", "at", "value", part).repartition(self.parts, "part").sortWithinPartitions("part", "file", "at").write.partitionBy("part").parquet(self.path)
        drop_kept(held)
        self._frame._kept_at = self.path

    def drop(self) -> None:
        drop_kept(self._frame)

    def reader(self) -> Callable[[], Callable]:
        """What a task calls to get its _picker()."""
        return functools.partial(_picker, self.path, self.parts)


def _picker(path: str, parts: int) -> Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(file, at) of rows -> the positions of those that are marked, and their values."""
    held: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def fetch(file: int) -> tuple[np.ndarray, np.ndarray]:
        from pyarrow import fs, parquet

        if file not in held:
            if len(held) >= 64:
                held.clear()
            store, inner = filesystem(f"{path}/part={file % parts}")
            at, value = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for info in store.get_file_info(fs.FileSelector(inner, allow_not_found=True)):
                if info.path.endswith(".parquet"):
                    with store.open_input_file(info.path) as f:
                        rows = parquet.ParquetFile(f).read()
                    mine = rows.column("file").to_numpy() == file
                    at.append(rows.column("at").to_numpy()[mine])
                    value.append(rows.column("value").to_numpy()[mine])
            at, value = np.concatenate(at), np.concatenate(value)
            order = np.argsort(at, kind="stable")
            held[file] = at[order], value[order]
        return held[file]

    def pick(files: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        where, values = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for file in np.unique(files).tolist():
            at, value = fetch(file)
            mine = np.flatnonzero(files == file)
            if len(at):
                k = np.minimum(np.searchsorted(at, rows[mine]), len(at) - 1)
                hit = at[k] == rows[mine]
                where.append(mine[hit])
                values.append(value[k[hit]])
        where, values = np.concatenate(where), np.concatenate(values)
        order = np.argsort(where, kind="stable")
        return where[order], values[order]

    return pick


def marked_rows(df: DataFrame, marks: Marks) -> DataFrame:
    """The rows of df, all columns, that marks lists; df as located() took it."""
    reader, names = marks.reader(), df.columns

    def run(batches):
        pick = reader()
        for batch in small(batches):
            where, _ = pick(batch.column(0).to_numpy(), batch.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([c.take(pa.array(where)) for c in batch.columns[2:]], names=names)

    return located(df).mapInArrow(run, df.schema)


def join_hot(many: DataFrame, one: DataFrame, key: str, weight: str, total: int, small_total: int = 100_000) -> DataFrame:
    """many with the row of one that has its key, where a key may have a large share of many's rows.

    one has a row for each key, and in weight how many rows of many there are. If many has at
    most small_total rows (total says how many), one is broadcast. Else keys with over a 50,000th of all, so at
    most 50,000, are broadcast, and the others are joined by a shuffle.
    """
    if total <= small_total:
        return many.join(F.broadcast(one.drop(weight)), key)
    hot = one.where(F.col(weight) > F.lit(max(64, total // 50_000)))
    rest = one.where(F.col(weight) <= F.lit(max(64, total // 50_000)))
    out = [*many.columns, *(c for c in one.columns if c not in (key, weight))]
    first = many.join(F.broadcast(hot), key).select(*out)
    second = many.join(F.broadcast(hot.select(key)), key, "left_anti").join(rest, key).select(*out)
    return first.union(second)


def word_count(text):
    """Number of words in a text column; null counts as none. JVM only."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hex_digits(n_rows: int, rows_per_bucket: int) -> int:
    """How many leading hex digits of a uniform key make buckets of about rows_per_bucket."""
    digits = 1
    while digits < 6 and n_rows > rows_per_bucket * 16**digits:
        digits += 1
    return digits
