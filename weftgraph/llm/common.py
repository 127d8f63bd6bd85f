"""Helpers shared by the corpus operators: tables, shared storage, Arrow batches."""

from __future__ import annotations

import ctypes
import gc
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Bytes that separate words, in every contract of this subpackage.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(column: Column) -> Column:
    """Lower-cases A-Z and nothing else."""
    return F.translate(column, _UPPER, _LOWER)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs inside go when it has ended: its result is written, and nothing reads them again."""
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, before)


class Scratch:
    """Written tables in the folder that the cluster names in spark.checkpoint.dir.

    They cut lineage without a second run of what they hold, and outlive lost executors. What drop() leaves goes when the
    application ends, as results are read from it until then.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if not base:
            if not re.match(r"local(\[|$)", spark.sparkContext.master):
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="weft-")
            spark.sparkContext.setCheckpointDir(base)
        self.base = f"{base.rstrip('/')}/weft-{uuid.uuid4().hex}"
        self.n = 0
        path, files = self._at(self.base)
        files.mkdirs(path)
        files.deleteOnExit(path)

    def _at(self, path: str) -> tuple:
        found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def save(self, df: DataFrame, **options: str) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        with _shuffles_removed(self.spark):
            df.write.options(**options).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._weft_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a saved table that nothing will read again."""
        path, files = self._at(df._weft_path)
        files.delete(path, True)


def byte_values(array: pa.Array) -> list[bytes]:
    """Texts as UTF-8; null counts as empty."""
    array = pc.fill_null(array.cast(pa.binary()), b"")
    if not len(array):
        return []
    _, offsets, data = array.buffers()
    at = np.frombuffer(offsets, np.int32)[array.offset : array.offset + len(array) + 1].tolist()
    whole = memoryview(data) if data is not None else memoryview(b"")
    return [bytes(whole[a:b]) for a, b in zip(at, at[1:], strict=False)]


def packed(values: np.ndarray, kind: str) -> bytes:
    """Values by byte planes: those of high bytes are mostly zero and compress well."""
    values = np.ascontiguousarray(values).astype(kind)
    return values.view(np.uint8).reshape(len(values), values.dtype.itemsize).T.tobytes()


def unpacked(parts: list[bytes], kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    return np.concatenate([np.zeros(0, kind), *[np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(width, len(x) // width).T).view(kind).reshape(-1) for x in parts]])


def slices(batches: Iterator[pa.RecordBatch], column: str, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Cuts batches so that each holds about `limit` bytes of a column, one row at least."""
    for batch in batches:
        sizes = pc.binary_length(batch.column(column)).to_pylist()
        begin = total = 0
        for i, size in enumerate(sizes):
            if i > begin and total + (size or 0) > limit:
                yield batch.slice(begin, i - begin)
                begin, total = i, 0
            total += size or 0
        if begin < len(sizes):
            yield batch.slice(begin)


def give_back() -> None:
    """Gives a worker's unused memory back."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def lean(run):
    """run, for mapInArrow(): a worker gives unused memory back at the end of a task, as others' stages follow in it."""

    def running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return running


def wider(df: DataFrame, added: str) -> StructType:
    """The schema of df with added fields, as DDL, behind its own."""
    return StructType([*df.schema.fields, *StructType.fromDDL(added).fields])


class Index(dict):
    """Numbers keys in order of their first use; `new` lists those that were added since it was last emptied."""

    def __init__(self) -> None:
        super().__init__()
        self.new: list = []

    def __missing__(self, key) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n

    def of(self, keys: list[list]) -> np.ndarray:
        """The numbers of all keys of all lists."""
        return np.fromiter(map(self.__getitem__, chain.from_iterable(keys)), np.int64, sum(map(len, keys)))


class Runs:
    """Runs of ids in one array: run i is ids[starts[i] : starts[i] + lens[i]]."""

    def __init__(self, kind: type) -> None:
        self.ids, self.starts, self.lens = np.zeros(0, kind), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, lens: np.ndarray, starts: np.ndarray | None = None) -> None:
        """Runs one behind the other, or those that start at the given places of ids."""
        self.starts = np.concatenate([self.starts, len(self.ids) + (np.cumsum(lens) - lens if starts is None else starts)])
        self.lens = np.concatenate([self.lens, lens])
        self.ids = np.concatenate([self.ids, ids.astype(self.ids.dtype)])

    def join(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs `at`, one behind the other, and the end of each."""
        n = self.lens[at]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        kind = np.int32 if max(total, len(self.ids)) < 1 << 31 else np.int64
        where = np.repeat((self.starts[at] - ends + n).astype(kind), n)
        where += np.arange(total, dtype=kind)
        return self.ids[where], ends


def split_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """Numbers of words of each text, the words as codes, and the distinct words behind the codes; cut at ASCII white space."""
    n, codes, distinct = coded_words(texts, lower)
    return n, codes, byte_values(distinct)


def coded_words(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """As split_words(), with the distinct words as an array."""
    texts = pc.fill_null(texts, "")
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    coded = parts.flatten().dictionary_encode()
    n = pc.list_value_length(parts).to_numpy().astype(np.int64)
    codes, distinct = coded.indices.to_numpy().astype(np.int64), coded.dictionary
    empty = pc.index(distinct, "").as_py()
    if empty >= 0:  # before leading white space, behind trailing, and of an empty text
        real = codes != empty
        n = np.bincount(np.repeat(np.arange(len(n)), n)[real], minlength=len(n))
        codes = codes[real]
        codes -= codes > empty
        distinct = pa.concat_arrays([distinct[:empty], distinct[empty + 1 :]])
    return n, codes, distinct


#: Words of more bytes are hashed one by one.
SHORT = 64


def word_hashes(words: pa.Array) -> np.ndarray:
    """64 bits of each word, by its length and all its bytes; short words are mixed side by side, 8 bytes at a time."""
    _, offsets, data = words.buffers()
    ends = np.frombuffer(offsets, np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64) if len(words) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    padded = np.concatenate([raw, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(raw) + 1, "<u8", padded, strides=(1,))  # those that begin at each byte
    starts, size = ends[:-1] - ends[0], np.diff(ends)
    masks = np.array([(1 << 8 * i) - 1 for i in range(9)], np.uint64)
    out = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, SHORT, 8):
        left = np.nonzero(size > at)[0]
        if not len(left):
            break
        x = out[left] ^ (eight[starts[left] + at] & masks[np.minimum(size[left] - at, 8)])
        for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
            x = (x ^ (x >> np.uint64(33))) * np.uint64(factor)
        out[left] = x ^ (x >> np.uint64(33))
    for i in np.nonzero(size > SHORT)[0]:
        out[i] = xxhash.xxh64_intdigest(raw[starts[i] : starts[i] + size[i]].tobytes())
    return out


#: 128 bits that are the same for rows of equal doc_id and text. Names that begin with _weft_ are reserved.
KEY = ["_weft_key", "_weft_more"]


def keyed(docs: DataFrame) -> DataFrame:
    """Adds the columns of KEY."""
    return docs.withColumns({KEY[0]: F.xxhash64("doc_id", "text"), KEY[1]: F.xxhash64(F.lit(1), "text", "doc_id")})


def numbered(rows: DataFrame, *order: str) -> DataFrame:
    """Adds _weft_nth, which tells rows of one key apart: in order of columns, then of all others, so that only equal rows tie."""
    rest = [f.name for f in rows.schema.fields if f.name not in (*KEY, "doc_id", "text") and "map<" not in f.dataType.simpleString()]
    by = F.xxhash64(*[F.col(f"`{c}`") for c in rest]) if rest else F.lit(0)
    return rows.withColumn("_weft_nth", F.row_number().over(Window.partitionBy(*KEY).orderBy(*order, by)))


def attached(docs: DataFrame, decided: DataFrame, order: str, how: str, *shared: str, **columns: Column) -> DataFrame:
    """docs with columns of the row of `decided` (KEY and others) that stands for the same row.

    Rows of one key stand for each other in order: of `shared` columns on both sides, then of `order` among the decided. A
    join on the key alone keeps the partitioning that numbered the rows: texts move once.
    """
    narrow = numbered(decided, *shared, order).select(*[F.col(k).alias(f"{k}_d") for k in (*KEY, "_weft_nth")], *[c.alias(n) for n, c in columns.items()])
    match = (F.col("_weft_nth") - F.col("_weft_nth_d")) == 0
    for k in KEY:
        match &= F.col(k) == F.col(f"{k}_d")
    return numbered(keyed(docs), *shared).join(narrow, match, how).select(*[F.col(f"`{c}`") for c in docs.columns], *columns)
