"""Byte-level BPE encoding and decoding with a public vocabulary file.

A piece is a doubly linked list of symbols. A priority queue holds the merge ranks of neighbouring
pairs; the lowest rank is merged first, its two new neighbour pairs are queued, and entries whose
symbols have changed meanwhile are skipped when they come up. Decoding concatenates the vocabulary's
strings. Results equal the public ``tokenizers`` library's with ``add_special_tokens=False``: strings of
the file's added tokens in a text become those tokens.

Null and empty texts give no tokens and decode to the empty text. Long texts and long pieces take
n log n steps. Repeated rows give equal results. An empty table gives an empty result.
"""

from __future__ import annotations

import json
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, DataType, StringType, StructField, StructType

#: Fixed value: the published splitting pattern of this vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE = 120_000  # pieces of a generation; a worker remembers two at most, some 50 MB
ALONE = 400_000  # the same where nothing else needs the workers' memory
LONG = 64  # characters of the longest piece that is remembered


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in the vocabulary's strings."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class _Pieces(dict):
    """Piece -> packed ids; a bounded memory in two generations, so that frequent pieces stay in it."""

    def __init__(self, merge, most: int):
        super().__init__()
        self.merge, self.most, self.older = merge, most, {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            ids = array("I", self.merge(piece.encode("utf-8", "surrogatepass"))).tobytes()
        if len(piece) <= LONG:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[piece] = ids
        return ids


class Bpe:
    """Encoder and decoder of one vocabulary file (the JSON form of the public tokenizers library)."""

    def __init__(self, spec: str | dict, cache: int = CACHE):
        spec = json.loads(spec) if isinstance(spec, str) else spec
        vocab = spec["model"]["vocab"]
        chars = byte_characters()
        value = {c: b for b, c in enumerate(chars)}
        self.byte_id = [vocab[c] for c in chars]
        self.ranks: dict[int, int] = {}  # of a pair of ids
        self.made: list[int] = []  # the id that a rank's pair becomes
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.ranks.setdefault(vocab[left] << 20 | vocab[right], rank)
            self.made.append(vocab[left + right])
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.strings = [b""] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in [*vocab.items(), *added.items()]:
            self.strings[i] = b"".join(bytes([value[c]]) if c in value else c.encode() for c in token)
        self.added = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.split = regex.compile(PATTERN)
        self.pieces = _Pieces(self.merge, cache)

    def merge(self, piece: bytes) -> list[int]:
        ids = [self.byte_id[b] for b in piece]
        n, ranks, made = len(ids), self.ranks.get, self.made
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # an entry is rank and place in one number: the lowest rank first, then the leftmost
        queue = [r << 32 | i for i in range(n - 1) if (r := ranks(ids[i] << 20 | ids[i + 1])) is not None]
        heapify(queue)
        while queue:
            entry = heappop(queue)
            rank, i = entry >> 32, entry & 0xFFFFFFFF
            left, j = ids[i], after[i]
            if left < 0 or j >= n or ranks(left << 20 | ids[j]) != rank:
                continue  # stale: one of the two has been merged since
            ids[i], ids[j] = new, _ = made[rank], -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := ranks(new << 20 | ids[k])) is not None:
                    heappush(queue, r << 32 | i)
            h = before[i]
            if h >= 0 and (r := ranks(ids[h] << 20 | new)) is not None:
                heappush(queue, r << 32 | h)
        return [x for x in ids if x >= 0]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if self.special is None:
            return b"".join(map(self.pieces.__getitem__, self.split.findall(text)))
        out = []
        for part in self.special.split(text):
            out.append(self.added[part] if part in self.added else b"".join(map(self.pieces.__getitem__, self.split.findall(part))))
        return b"".join(out)

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.strings.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_LOADED: dict[tuple[int, int], Bpe] = {}


def _of(shared) -> Bpe:
    """One encoder for each Python worker and vocabulary."""
    key, spec = shared.value
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(spec, key[1])
    return _LOADED[key]


def _share(spark: SparkSession, vocabulary: str, cache: int):
    """The vocabulary file (some MB, whatever the input) as a broadcast."""
    with open(vocabulary, encoding="utf-8") as f:
        spec = f.read()
    return spark.sparkContext.broadcast(((hash(spec), cache), spec))


def _appended(df: DataFrame, column: str, name: str, kind: DataType, of) -> DataFrame:
    df = df.drop(name)
    at = df.columns.index(column)
    names = [*df.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, max(1, batch.num_rows), 500):
                part = batch.slice(i, 500)
                if part.num_rows:
                    yield pa.RecordBatch.from_arrays([*part.columns, of(part.column(at))], names)

    schema = StructType([*df.schema.fields, StructField(name, kind)])
    return df.mapInArrow(run, schema)


def bpe_encode(spark: SparkSession, df: DataFrame, vocabulary: str, text_col: str = "text", out_col: str = "ids", cache: int = CACHE) -> DataFrame:
    """``df`` with the binary column ``out_col``: ids as little-endian unsigned 32-bit integers."""
    shared = _share(spark, vocabulary, cache)

    def of(col: pa.Array) -> pa.Array:
        bpe = _of(shared)
        return pa.array([bpe.encode(t or "") for t in col.to_pylist()], pa.binary())

    return _appended(df, text_col, out_col, BinaryType(), of)


def bpe_decode(spark: SparkSession, df: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded", cache: int = CACHE) -> DataFrame:
    """``df`` with the string column ``out_col``: the vocabulary's strings of the ids, one after another."""
    shared = _share(spark, vocabulary, cache)

    def of(col: pa.Array) -> pa.Array:
        bpe = _of(shared)
        return pa.array([bpe.decode(x or b"") for x in col.to_pylist()], pa.string())

    return _appended(df, ids_col, out_col, StringType(), of)


def bpe_digests(spark: SparkSession, docs: DataFrame, vocabulary: str, cache: int = CACHE) -> DataFrame:
    """Each document's token count and the digests of its ids and of what they decode to."""
    ids = bpe_encode(spark, docs.select("doc_id", "text"), vocabulary, cache=cache).select("doc_id", "ids")
    both = bpe_decode(spark, ids, vocabulary, cache=cache)
    return both.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"),
    )


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return bpe_digests(spark, docs, default_vocabulary(), ALONE)
