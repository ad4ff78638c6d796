"""What the operators share: word splitting, 64-bit hashes and tables in the shared scratch folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The ASCII white space that separates words, as a Java/RE2 character class.
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8. bytes.split() splits on exactly space and \\x09-\\x0D."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def lower_words_of(text: str | None) -> list[bytes]:
    """The same with A-Z lower-cased (bytes.lower() leaves all else alone)."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


class WordHashes:
    """64-bit hashes of words, remembered up to a bounded number of distinct words."""

    def __init__(self, limit: int = 100_000):
        self.limit, self.seen = limit, {}

    def __call__(self, words: list[bytes]) -> np.ndarray:
        got = list(map(self.seen.get, words))
        if None in got:
            digest, seen = xxhash.xxh3_64_intdigest, self.seen
            for i, h in enumerate(got):
                if h is None:
                    h = got[i] = digest(words[i])
                    if len(seen) < self.limit:
                        seen[words[i]] = h
        return np.array(got, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and xor-shift); input and output are uint64."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def rolling(h: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of `width` consecutive word hashes."""
    n = len(h) - width + 1
    if n <= 0:
        return h[:0]
    with np.errstate(over="ignore"):
        out = np.full(n, np.uint64(0x9E3779B97F4A7C15) * np.uint64(width))
        for k in range(width):
            out = mix(out ^ h[k : k + n]) + np.uint64(2 * k + 1)
    return out


def shingle_set(h: np.ndarray, width: int) -> np.ndarray:
    """Sorted distinct shingles; a shorter text is one shingle, an empty one has none."""
    if not len(h):
        return h
    return np.unique(rolling(h, min(width, len(h))))


def slices(batches: Iterable[pa.RecordBatch], rows: int = 512, size: int = 1 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows and about `size` bytes of a text column; a longer text is a part by itself."""
    for b in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(b[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < b.num_rows:
            full = int(np.searchsorted(ends, (int(ends[at - 1]) if at else 0) + size, "right"))
            to = min(at + rows, max(full, at + 1), b.num_rows)
            yield b.slice(at, to - at)
            at = to


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The shared folder named in spark.checkpoint.dir. Only a local master may do without: it gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='cartolake-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Settings while a table is written: its shuffle files are removed at the end, and batches for workers are small even of long texts.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "4m"}


@contextmanager
def writing(spark: SparkSession) -> Iterator[None]:
    """Sets WRITING and what was set before again."""
    before = {k: spark.conf.get(k) for k in WRITING}
    for k, v in WRITING.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


class Scratch:
    """Written tables in the shared folder: they cut lineage, and executors can be lost without losing them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.n = spark, f"{shared_dir(spark)}/cartolake/{name}-{uuid.uuid4().hex}", 0

    def path(self, what: str) -> str:
        self.n += 1
        return f"{self.root}/{self.n:03d}-{what}"

    def keep(self, df: DataFrame, what: str = "t") -> DataFrame:
        """Write, and read back with the same schema. The write's shuffle files go when it has ended."""
        where = self.path(what)
        with writing(self.spark):
            df.write.parquet(where)
        return self.spark.read.schema(df.schema).parquet(where)

    def drop(self, *tables: DataFrame) -> None:
        """Remove tables that no later plan reads."""
        for t in tables:
            for parent in {f.rsplit("/", 1)[0] for f in t.inputFiles()}:
                if parent.startswith(self.root) or self.root.split(":", 1)[-1].lstrip("/") in parent:
                    self.remove(parent)

    def remove(self, where: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def map_batches(df: DataFrame, each: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str) -> DataFrame:
    """mapInArrow with a function from batch to batch."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield each(b)

    return df.mapInArrow(run, schema)


def bucket(doc_id: str, of: int):
    """crc32 of doc_id as text, modulo `of`."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(of))
