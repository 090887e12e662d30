"""Helpers that several training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.operators.graph import components  # noqa: F401  for the operators here

U64 = np.uint64


def _lean() -> None:
    """An executor runs several Python workers: what they free goes back to the system at once."""
    pa.set_memory_pool(pa.system_memory_pool())
    try:  # glibc: fixed thresholds for mapping and trimming (options -3 and -1 of mallopt)
        libc = ctypes.CDLL(None)
        libc.mallopt(-3, 1 << 19)
        libc.mallopt(-1, 1 << 19)
    except (AttributeError, OSError):
        pass


_lean()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only on a local master may the session name none: then a temporary folder is used.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = getattr(spark, "_own_shared_dir", None)
        if base is None:
            base = spark._own_shared_dir = "file://" + tempfile.mkdtemp(prefix="shared-")
    return base.rstrip("/")


class Scratch:
    """Written tables of one operator call; they cut the lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex[:12]}"
        self.written = 0

    def write(self, df: DataFrame, compression: str = "zstd") -> DataFrame:
        self.written += 1
        path = f"{self.root}/t{self.written}"
        df.write.option("compression", compression).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Remove a table that no later step reads."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(df._scratch_path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def bucket_count(df: DataFrame, least: int = 1024, each: int = 64 << 20) -> int:
    """A power of two: about one bucket for each 64 MB of input as the optimiser estimates it."""
    size = int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return min(1 << 22, max(least, 1 << max(0, (size // each)).bit_length()))


def mix64(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A bijective scrambler of 64-bit words (the finaliser of the public SplitMix64 generator)."""
    with np.errstate(over="ignore"):
        x = x.astype(U64) + U64((0x9E3779B97F4A7C15 * (salt + 1)) & 0xFFFFFFFFFFFFFFFF)
        x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
        return x ^ (x >> U64(31))


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column, one after another, and where each row starts (n + 1 offsets)."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = col.fill_null("")
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = col.buffers()
    at = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[at[0] : at[-1]], at - at[0]


def slices(starts: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[int, int]]:
    """Runs of whole rows of about ``most`` bytes each (a longer row stands alone)."""
    i, n = 0, len(starts) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + most, "right")) - 1)
        j = min(j, n)
        yield i, j
        i = j


_BASE = U64(0x9E3779B97F4A7C15)
_BASE_INVERSE = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTE = mix64(np.arange(256, dtype=U64), 11)
_POWERS: dict[str, np.ndarray] = {}
#: A-Z as a-z.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        size = 1 << max(20, int(n).bit_length())
        with np.errstate(over="ignore"):
            for name, base in (("up", _BASE), ("down", _BASE_INVERSE)):
                x = np.full(size, base, U64)
                x[0] = 1
                _POWERS[name] = np.multiply.accumulate(x)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_hashes(data: np.ndarray, starts: np.ndarray, in_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of some texts, A-Z as a-z, and where each text's words start (n + 1 offsets).

    A word is a run of bytes for which ``in_word`` (of 256) holds, within a text (bytes from starts[i] to starts[i + 1]).
    """
    none = np.zeros(0, U64), np.zeros(len(starts), np.int64)
    if len(starts) < 2 or len(data) == 0:
        return none
    data = LOWER[data]
    word = in_word[data]
    before = np.concatenate(([False], word[:-1]))
    first = np.zeros(len(data) + 1, bool)
    first[starts[:-1]] = True
    begin = np.flatnonzero(word & (~before | first[:-1]))
    after = np.concatenate((word[1:], [False]))
    last = np.zeros(len(data), bool)
    last[starts[1:][starts[1:] > 0] - 1] = True
    end = np.flatnonzero(word & (~after | last)) + 1
    if len(begin) == 0:
        return none
    up, down = _powers(len(data))
    with np.errstate(over="ignore"):
        total = np.concatenate((np.zeros(1, U64), np.add.accumulate(_BYTE[data] * up)))
        words = mix64((total[end] - total[begin]) * down[begin] + (end - begin).astype(U64))
    return words, np.searchsorted(begin, starts)


class UnionFind:
    """Disjoint sets over 0..n-1 inside one task; the smallest index is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def key_runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, list[tuple]]]:
    """Consecutive rows of a sorted partition that agree in the first ``keys`` columns: (key, rows).

    A run may continue over Arrow batches; only one run is held at a time.
    """
    held_key, held = None, []
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            for row in zip(*(c.to_pylist() for c in batch.slice(at, 256).columns), strict=True):
                if (k := row[:keys]) != held_key:
                    if held:
                        yield held_key, held
                    held_key, held = k, []
                held.append(row[keys:])
    if held:
        yield held_key, held


def by_key(df: DataFrame, keys: list[str], spread: bool = False) -> DataFrame:
    """Rows of a key side by side in one partition, keys first: the input that ``key_runs`` reads.

    With ``spread`` small partitions aren't coalesced: for work that costs much a byte.
    """
    rest = [c for c in df.columns if c not in keys]
    count = [int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))] if spread else []
    return df.select(*keys, *rest).repartition(*count, *keys).sortWithinPartitions(*keys)


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its components are finite numbers."""
    good = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return vector.isNotNull() & F.forall(vector, good)


def usual_length(vectors: DataFrame, column: str) -> int | None:
    """The most frequent length of non-empty vectors, of equally frequent ones the largest; None without any."""
    sizes = vectors.groupBy(F.size(column).alias("dim")).agg(F.count("*").alias("n")).where("dim > 0")
    top = sizes.orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    return top[0]["dim"] if top else None


def meet_groups(rows: DataFrame, groups: DataFrame, keys: list[str], size: str, total: int, share: int = 10_000) -> DataFrame:
    """``rows`` with the columns of their group (one row a key in ``groups``, which has each group's number of rows in ``size``).

    Groups of over a ten-thousandth of ``total`` rows are fewer than ten thousand: they are broadcast. All others meet
    their rows in a shuffle, where none of them stands out. Keys must not be null.
    """
    large = F.col(size) * share > max(total, share)
    hot = F.broadcast(groups.where(large))
    some = rows.join(hot, keys)
    rest = rows.join(F.broadcast(groups.where(large).select(*keys)), keys, "left_anti")
    return some.unionByName(rest.join(groups.where(~large), keys))


class Bloom:
    """A set of ids in a bit table, built in pieces: what fails it isn't in the set.

    The table has 16 bits an id, 128 MB at most. It thins a large table before an exact join; where the set outgrows
    the table (some 200 million ids) it lets more through, but never changes the join's result.
    """

    LEAST, MOST, PIECES = 1 << 20, 1 << 30, 256

    def __init__(self, shared, bits: int):
        self.shared, self.bits = shared, bits

    @staticmethod
    def _places(ids: np.ndarray, bits: int) -> list[np.ndarray]:
        return [(mix64(ids, 21 + k) % U64(bits)).astype(np.int64) for k in range(3)]

    @staticmethod
    def of(ids: DataFrame) -> Bloom:
        size = Bloom.LEAST
        wanted = min(16 * ids.count(), Bloom.MOST)
        while size < wanted:
            size *= 2
        bits, width = size, size // Bloom.PIECES

        def emit(piece: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.concatenate(([True], piece[1:] // width != piece[:-1] // width))) if len(piece) else []
            ends = [*cut[1:], len(piece)]
            return pa.RecordBatch.from_arrays(
                [
                    pa.array([int(piece[a] // width) for a in cut], pa.int32()),
                    pa.array([(piece[a:b] % width).astype("<u4").tobytes() for a, b in zip(cut, ends, strict=False)], pa.binary()),
                ],
                ["piece", "bits"],
            )

        def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                x = batch.column(0).drop_null().to_numpy(zero_copy_only=False)
                yield emit(np.unique(np.concatenate(Bloom._places(x, bits))))

        def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for (piece,), rows in key_runs(batches, 1):
                table = np.zeros(width, bool)
                for (bits,) in rows:
                    table[np.frombuffer(bits, "<u4")] = True
                packed = np.packbits(table).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([piece], pa.int32()), pa.array([packed], pa.binary())], ["piece", "bits"])

        found = by_key(ids.mapInArrow(places, "piece int, bits binary"), ["piece"]).mapInArrow(tables, "piece int, bits binary")
        whole = np.zeros(bits // 8, np.uint8)
        size = width // 8
        for piece, table in found.collect():  # 256 pieces of 512 KB at most, whatever the input
            whole[piece * size : (piece + 1) * size] = np.frombuffer(table, np.uint8)
        return Bloom(ids.sparkSession.sparkContext.broadcast(whole), bits)

    @staticmethod
    def holds(table: np.ndarray, bits: int, ids: np.ndarray) -> np.ndarray:
        """Which ids the broadcast table lets through."""
        keep = np.ones(len(ids), bool)
        for at in Bloom._places(ids, bits):
            keep &= (table[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1
        return keep

    def where(self, df: DataFrame, column: int, within: bool = True) -> DataFrame:
        """Rows whose id passes; with ``within=False`` those whose id is certainly not in the set, or null."""
        shared, bits = self.shared, self.bits

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            table = shared.value
            for batch in batches:
                ids = batch.column(column).fill_null(0).to_numpy(zero_copy_only=False)
                keep = batch.column(column).is_valid().to_numpy(zero_copy_only=False) & Bloom.holds(table, bits, ids)
                yield batch.filter(pa.array(keep if within else ~keep))

        return df.mapInArrow(run, df.schema)


def free_name(columns: list[str], name: str) -> str:
    """A column name like ``name`` that none of the columns has, in any case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


#: Numbers of documents whose id several rows have start here.
SHARED_IDS = 1 << 62


def numbered(docs: DataFrame, name: str, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """``docs`` with a number for each document in column ``name``, and whether different texts share ids.

    A row's number is its id, or, where rows with different texts have that id, a hash of id and text from ``SHARED_IDS`` on (62 bits:
    two of a million such rows agree by chance once in about ten million cases). So rows that agree in id and text are one document,
    and rows that only share the id are several. Rows without an id have no number. Ids must be below ``SHARED_IDS``.
    """
    own, spark = F.col(id_col).cast("long"), docs.sparkSession
    key, scratch = free_name([*docs.columns, name], "id"), Scratch(spark, "shared-ids")
    text = F.coalesce(F.col(text_col), F.lit(""))
    again = docs.select(own.alias(key)).where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key)
    again = scratch.write(again)
    if again.isEmpty():
        return docs.withColumn(name, own), False
    seen = Bloom.of(again).where(docs.select(own.alias(key), text_col), 0).groupBy(key).agg(F.min(F.xxhash64(text)).alias("a"), F.max(F.xxhash64(text)).alias("b"))
    again = scratch.write(seen.where("a <> b").select(key))
    n = again.count()
    if n == 0:
        return docs.withColumn(name, own), False
    some, at = Bloom.of(again), docs.columns.index(id_col)
    mark = free_name([*docs.columns, name, key], "shared")
    small = again.select(key, F.lit(True).alias(mark))
    near = some.where(docs, at).join(F.broadcast(small) if n <= 2_000_000 else small, own == F.col(key), "left")
    number = F.pmod(F.xxhash64(own, text), F.lit(SHARED_IDS)) + F.lit(SHARED_IDS)
    near = near.withColumn(name, F.when(F.col(mark), number).otherwise(own)).select(*docs.columns, name)
    return some.where(docs, at, within=False).withColumn(name, own).unionByName(near), True


def without(docs: DataFrame, removed: DataFrame, id_col: str = "doc_id", removed_col: str = "doc_id", once: bool = False) -> DataFrame:
    """Rows of ``docs`` whose id isn't in ``removed``; with ``once`` one row of each id stays.

    Only rows that the Bloom table of removed (and of repeated) ids lets through meet others in a shuffle;
    all the rest, and so nearly all texts, stay where they are. Rows without an id stay.
    """
    key = free_name(docs.columns, "id")
    ids = removed.select(F.col(removed_col).cast("long").alias(key)).where(F.col(key).isNotNull()).distinct()
    some = ids
    if once:
        again = docs.groupBy(F.col(id_col).cast("long").alias(key)).agg(F.count("*").alias("n")).where(F.col(key).isNotNull() & (F.col("n") > 1))
        some = ids.unionByName(again.select(key))
    some, at = Bloom.of(some), docs.columns.index(id_col)
    near = some.where(docs.where(F.col(id_col).isNotNull()), at)
    near = (near.dropDuplicates([id_col]) if once else near).join(ids, F.col(id_col) == F.col(key), "left_anti")
    return some.where(docs, at, within=False).unionByName(near)
