"""What the operators share: tables, materialised steps, byte-level tokens and distributed ranks."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GOLD = np.uint64(0x9E3779B97F4A7C15)
_written: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir, which all executors share. Where it is unset (a local session), a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="tamarack-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame) -> DataFrame:
    """Write a step as Parquet into the shared folder and read it again: the lineage ends there, and a lost executor costs only a re-read."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/step-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def written() -> int:
    """How many tables of materialize() there are: a mark for release()."""
    return len(_written)


@atexit.register
def release(since: int = 0, until: int | None = None) -> None:
    """Delete the tables that materialize() wrote from one mark to another, which nothing may read any more; all of them at exit."""
    for spark, path in _written[since:until]:
        try:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
        except Exception:
            break  # the session has ended
    del _written[since:until]


def col(name: str) -> Column:
    """A column by its exact name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def unused(columns: list[str], *stems: str) -> list[str]:
    """For each stem a name that is none of the columns' in any letter case."""
    taken, out = {c.lower() for c in columns}, []
    for name in stems:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---------------------------------------------------------------- text as bytes

#: ASCII white space, as \\s in SQL regular expressions.
SPACES = b" \t\n\r\f"


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and offsets of an Arrow string column; nulls are empty."""
    if column.null_count:
        column = column.fill_null("")
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n or column.buffers()[1] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(offsets: np.ndarray, size: int = 1 << 20):
    """Row ranges [a, b) of about `size` bytes; a longer text is a range of its own."""
    a, n = 0, len(offsets) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, side="right")) - 1)
        yield a, b
        a = b


def spans(data: np.ndarray, offsets: np.ndarray, size: int = 1 << 20):
    """As chunks(), with the bytes [lo, hi) and whether the last text ends there: (a, b, lo, hi, ends). A longer text is cut at white space, into pieces of about `size`."""
    for a, b in chunks(offsets, size):
        lo, end = int(offsets[a]), int(offsets[b])
        while end - lo > size:
            hi = lo + size
            while hi < end and data[hi] not in SPACES:
                hi += 1
            if hi == end:
                break
            yield a, b, lo, hi, False
            lo = hi
        yield a, b, lo, end, True


def local(offsets: np.ndarray, a: int, b: int, lo: int, hi: int) -> np.ndarray:
    """Offsets of the texts [a, b) within the bytes [lo, hi)."""
    return np.clip(offsets[a : b + 1], lo, hi) - lo


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Tokenizer:
    """Splits texts at white space and hashes each word to 64 bits, all in numpy.

    A word's hash is the sum of a random value for each byte times a power of an odd number, modulo 2**64, so that
    one running product serves all words of a chunk; the power of the word's start is divided out. Bytes are summed in
    blocks, so that a long text takes no more than its words and a few bytes for each of its own.
    """

    BLOCK = 1 << 20

    def __init__(self) -> None:
        self.space = np.zeros(256, bool)
        self.space[list(SPACES)] = True
        self.value = mix64(np.arange(1, 257, dtype=np.uint64) * GOLD) | np.uint64(1)
        self.value[self.space] = 0
        self.base = np.uint64(0xD6E8FEB86659FD93)
        self.inverse = np.uint64(pow(int(self.base), -1, 1 << 64))
        self.powers, self.unpowers = (self._powers(x, self.BLOCK) for x in (self.base, self.inverse))

    @staticmethod
    def _powers(base, n: int) -> np.ndarray:
        x = np.full(n, base, np.uint64)
        x[:1] = 1
        return np.multiply.accumulate(x)

    def _sums(self, data: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Hash of each word before the finaliser. White space counts 0, so a word ends where the next one starts."""
        total = np.zeros(len(start), np.uint64)
        blocks = -(-len(data) // self.BLOCK)
        ups, downs = (self._powers(np.uint64(pow(int(x), self.BLOCK, 1 << 64)), blocks) for x in (self.base, self.inverse))
        for k in range(blocks):
            a = k * self.BLOCK
            part = self.value[data[a : a + self.BLOCK]]
            part *= self.powers[: len(part)]
            lo, hi = np.searchsorted(start, [a, a + self.BLOCK])
            edges, open_ = start[lo:hi] - a, lo > 0 and not (hi > lo and start[lo] == a)
            if open_:  # the word before goes on in this block
                edges = np.append(0, edges)
            if len(edges):
                total[lo - open_ : hi] += np.add.reduceat(part, edges) * ups[k]
        return total * self.unpowers[start % self.BLOCK] * downs[start // self.BLOCK]

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(row, start, end, hash) of each word; offsets begin at 0."""
        n = len(data)
        if not n:
            z = np.zeros(0, np.int64)
            return z, z, z, z.astype(np.uint64)
        space = self.space[data]
        first, last = np.empty(n, bool), np.empty(n, bool)
        first[0] = last[-1] = True
        first[1:], last[:-1] = space[:-1], space[1:]
        edges = offsets[(offsets > 0) & (offsets < n)]
        first[edges] = True
        last[edges - 1] = True
        start, end = np.flatnonzero(first & ~space), np.flatnonzero(last & ~space) + 1
        if not len(start):
            z = np.zeros(0, np.int64)
            return z, z, z, z.astype(np.uint64)
        row = np.searchsorted(offsets, start, side="right") - 1
        return row, start, end, mix64(self._sums(data, start))


def row_bounds(row: np.ndarray, n: int) -> np.ndarray:
    """Where the words of each of n rows begin, and the end."""
    return np.searchsorted(row, np.arange(n + 1))


# ---------------------------------------------------------------- ranks and running sums without one large partition


def md5_bucket(digest: Column, hex_digits: int) -> Column:
    return F.substring(digest, 1, hex_digits)


def running_sum(df: DataFrame, group: list[str], bucket: str, order: list[Column], value: Column, name: str) -> DataFrame:
    """Adds `name`, the sum of `value` over the rows of the group before this one, in the order of (bucket, order).

    Sums for each (group, bucket) are few; a window runs over them, and another inside each bucket, so that a group
    however large is spread over its buckets.
    """
    valued = df.withColumn("_value", value)
    sums = valued.groupBy(*group, bucket).agg(F.sum("_value").alias("_sum"))
    before = sums.select(*group, bucket, F.coalesce(F.sum("_sum").over(Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long").alias("_before"))
    inside = F.coalesce(F.sum("_value").over(Window.partitionBy(*group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return valued.withColumn("_inside", inside).join(before, [*group, bucket]).withColumn(name, (F.col("_before") + F.col("_inside")).cast("long")).drop("_value", "_inside", "_before")


# ---------------------------------------------------------------- words counted and rows told apart, inside the JVM


def word_count(text: Column) -> Column:
    """Words between ASCII white space; 0 for a null."""
    bare = F.trim(F.translate(F.coalesce(text, F.lit("")), "\t\n\r\f", "    "))
    return F.when(bare == "", 0).otherwise(F.size(F.split(bare, " +"))).cast("long")


def row_digest(seed: str, *columns: Column) -> Column:
    """md5 of the values with their nulls; equal rows have equal digests."""
    return F.md5(F.concat(F.lit(f"{seed}/"), *[F.concat(F.coalesce(c.cast("string"), F.lit("\\N")), F.lit("/")) for c in columns]))
