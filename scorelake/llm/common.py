"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but these six bytes.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local session gets one of its own."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows, read back from a table in the shared folder: cuts the lineage, and a lost executor costs no recomputation."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_to = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables that `written` wrote and nothing reads any more."""
    for df in tables:
        spark = df.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(df.written_to)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def fresh(name: str, columns: list[str]) -> str:
    """A column name like `name` that none of `columns` has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: A key with more than this share of all rows is hot. At most HOT_SHARE keys can be, which bounds what is broadcast.
HOT_SHARE = 1024


def join_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, how: str = "merge") -> DataFrame:
    """rows joined with groups, which has one row for each key and in `size` the number of `rows` with it, `total` being the number of all.

    Hot keys are joined by broadcast, so that no task gets all rows of one; the others by shuffle. `rows` is read twice.
    """
    hot = groups.where((F.col(size) * HOT_SHARE > total) & (F.col(size) > 1000))
    rare = rows.join(F.broadcast(hot.select(*keys)), keys, "left_anti").join(groups.hint(how), keys)
    return rows.join(F.broadcast(hot), keys).unionByName(rare)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ascii_lower(text: Column) -> Column:
    """A-Z to lower case and nothing else. Null stays null."""
    return F.when(text.rlike(r"[^\x00-\x7F]"), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def word_count(text: Column) -> Column:
    """Number of words; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 5 is 0; such rows never teach a model. A null id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def is_space() -> np.ndarray:
    table = np.zeros(256, dtype=bool)
    table[[0x20, *range(0x09, 0x0E)]] = True
    return table


SPACE = is_space()


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in an array of UTF-8 bytes."""
    word = np.zeros(len(data) + 2, dtype=np.int8)
    word[1:-1] = ~SPACE[data]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of unsigned 64-bit integers."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], dtype=np.uint64)
_LENGTH, _HIGH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of the bytes of each span: of up to 16 bytes two scrambled numbers, of more their XXH64. Seeds give independent hashes."""
    from xxhash import xxh64_intdigest

    padded = np.zeros(len(data) + 16, dtype=np.uint8)
    padded[: len(data)] = data
    eight = np.ndarray((len(data) + 9,), dtype="<u8", buffer=padded, strides=(1,))
    size = ends - starts
    low = eight[starts] & _MASKS[np.minimum(size, 8)]
    salt = mix64(np.array([seed + 1], dtype=np.uint64))[0]
    out = mix64((low ^ salt) + size.astype(np.uint64) * _LENGTH)
    longer = np.flatnonzero(size > 8)
    high = eight[starts[longer] + 8] & _MASKS[np.minimum(size[longer] - 8, 8)]
    out[longer] = mix64(out[longer] * _HIGH + mix64(high + salt))
    longest = np.flatnonzero(size > 16)
    if len(longest):
        raw = data.tobytes()
        out[longest] = np.array([xxh64_intdigest(raw[a:b], seed) for a, b in zip(starts[longest].tolist(), ends[longest].tolist(), strict=True)], dtype=np.uint64)
    return out


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bounds the rows of the session's Arrow batches, so that a batch of long texts fits beside others in an executor."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def text_chunks(batch, limit: int = 1 << 20):
    """Cuts an Arrow record batch with a column `text` into slices of about `limit` bytes (one long text may exceed it).

    Yields the slice, its texts as one array of UTF-8 bytes with a blank behind each, and where each begins. Null is empty.
    """
    import pyarrow as pa
    import pyarrow.compute as pc

    text = pc.fill_null(batch.column("text").cast(pa.large_string()), "")
    if not len(text):
        return
    _, at, data = text.buffers()
    at = np.frombuffer(at, dtype=np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    i = 0
    while i < len(text):
        j = max(int(np.searchsorted(at, at[i] + limit, "right")) - 1, i + 1)
        j = min(j, len(text))
        own = at[i : j + 1] - at[i]
        yield batch.slice(i, j - i), np.insert(data[at[i] : at[j]], own[1:], 0x20), own + np.arange(j - i + 1)
        i = j


def single_spaced(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The words with one blank behind each, and their starts and ends there."""
    starts, ends = word_spans(data)
    keep = ~SPACE[data]
    out = np.where(keep, data, np.uint8(0x20))
    keep[ends[ends < len(data)]] = True
    shift = np.cumsum(keep)
    return out[keep], np.where(starts > 0, shift[starts - 1], 0) if len(starts) else starts, shift[ends - 1] if len(ends) else ends


def split_words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """single_spaced(data), and for each document the index of its first word (one more entry: the number of words)."""
    before, _ = word_spans(data)
    return *single_spaced(data), np.searchsorted(before, at)
