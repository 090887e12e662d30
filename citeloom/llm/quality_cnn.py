"""Quality classifier: a byte-level convolutional network in numpy.

Bytes become vectors of ``DIM`` numbers; filters over eight bytes, at every fourth, run over the whole text.
Their responses are max-pooled in overlapping chunks of 1024 bytes (128 shared with the next), and a
text's probability comes from the mean and the maximum of its chunks. Embedding, filters and output
weights are learned together by Adam on log loss.

The network is fitted on the driver, on whole texts: the labelled rows of least hash, at most ``SAMPLE`` rows that
together have at most ``SAMPLE_BYTES`` bytes. Every text is scored whole. Labels are read from the label table
only; ids, language and source are never inputs.

Null and empty texts get the score of a text without chunks. Without labelled rows all scores are 0.5.
Repeated rows get equal scores; rows without an id are scored too. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citeloom.llm.common import slices, text_bytes

DIM, FILTERS, BLOCK, PIECE = 8, 16, 4, 32  # a piece is 32 blocks of four bytes
PIECES, STEP = 8, 7  # pieces in a chunk; from one chunk to the next
CHUNK_BYTES = PIECES * PIECE * BLOCK
SAMPLE, SAMPLE_BYTES, STEPS, BATCH = 3000, 32_000_000, 500, 64
THRESHOLD = 0.3


class ByteCnn:
    """Parameters, scoring and fitting."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        f32 = np.float32
        self.p = {
            "embed": rng.normal(0, 0.5, (256, DIM)).astype(f32),
            "filters": rng.normal(0, 0.18, (BLOCK * DIM, 2 * FILTERS)).astype(f32),
            "bias": np.zeros(FILTERS, f32),
            "mean": np.zeros(FILTERS, f32),
            "most": np.zeros(FILTERS, f32),
            "base": np.zeros(1, f32),
        }

    def responses(self, blocks: np.ndarray) -> np.ndarray:
        """Filter responses of blocks (n, 4 bytes), each with the block after it; the last has none."""
        x = self.p["embed"][blocks].reshape(len(blocks), BLOCK * DIM)
        z = x @ self.p["filters"]
        out = z[:, :FILTERS].copy()
        out[:-1] += z[1:, FILTERS:]
        return np.maximum(out + self.p["bias"], 0)

    def score(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Probabilities of texts laid end to end."""
        sizes = np.diff(starts)
        mean, most = np.zeros((len(sizes), FILTERS), np.float32), np.zeros((len(sizes), FILTERS), np.float32)
        full = np.flatnonzero(sizes > 0)
        if len(full):
            size = sizes[full]
            pieces = (size + BLOCK - 1) // (PIECE * BLOCK) + 1  # room for a block of padding after the text
            first = np.concatenate(([0], np.cumsum(pieces)))
            wide = np.zeros(int(first[-1]) * PIECE * BLOCK, np.uint8)
            shift = first[:-1] * PIECE * BLOCK - starts[:-1][full]
            wide[np.arange(len(data)) + np.repeat(shift, size)] = data
            out = self.responses(wide.reshape(-1, BLOCK))
            real = (size + BLOCK - 1) // BLOCK
            place = np.arange(len(out)) - np.repeat(first[:-1] * PIECE, pieces * PIECE)
            out[place >= np.repeat(real, pieces * PIECE)] = 0
            pooled = out.reshape(-1, PIECE, FILTERS).max(1)
            used = -(-size // (PIECE * BLOCK))
            n = np.maximum(0, -(-(used - PIECES) // STEP)) + 1
            chunk0 = np.concatenate(([0], np.cumsum(n)))[:-1]
            doc = np.repeat(np.arange(len(full)), n)
            low = first[:-1][doc] + STEP * (np.arange(len(doc)) - chunk0[doc])
            high = np.minimum(low + PIECES, first[:-1][doc] + used[doc])
            pooled = np.concatenate((pooled, np.zeros((1, FILTERS), np.float32)))
            chunk = np.maximum.reduceat(pooled, np.stack((low, high), 1).ravel(), axis=0)[::2]
            mean[full] = np.add.reduceat(chunk, chunk0, axis=0) / n[:, None]
            most[full] = np.maximum.reduceat(chunk, chunk0, axis=0)
        logit = mean @ self.p["mean"] + most @ self.p["most"] + self.p["base"]
        return 1 / (1 + np.exp(-logit.astype(np.float64)))

    def _gradient(self, x: np.ndarray, real: np.ndarray, doc: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the log loss; x: chunks with a block more (c, 257, 4), real: blocks of text in each, doc: its text."""
        p, c = self.p, len(x)
        e = p["embed"][x].reshape(c, -1, BLOCK * DIM)
        z = e @ p["filters"]
        out = np.maximum(z[:, :-1, :FILTERS] + z[:, 1:, FILTERS:] + p["bias"], 0)
        out[np.arange(out.shape[1])[None, :] >= real[:, None]] = 0
        arg = out.argmax(1)
        pooled = np.take_along_axis(out, arg[:, None, :], 1)[:, 0]
        begin = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
        n = np.diff(np.append(begin, c))
        at = np.repeat(np.arange(len(begin)), n)
        mean, most = np.add.reduceat(pooled, begin, axis=0) / n[:, None], np.maximum.reduceat(pooled, begin, axis=0)
        logit = mean @ p["mean"] + most @ p["most"] + p["base"]
        d = (1 / (1 + np.exp(-logit)) - y).astype(np.float32) / len(y)
        top = (pooled == most[at]) & (pooled > 0)
        g = (d[at] / n[at])[:, None] * p["mean"] + d[at][:, None] * p["most"] * top
        g = np.where(pooled > 0, g, 0).astype(np.float32)
        out = {"mean": mean.T @ d, "most": most.T @ d, "base": d.sum(keepdims=True), "bias": g.sum(0)}
        w, de = np.zeros_like(p["filters"]), np.zeros_like(p["embed"])
        rows = np.arange(c)
        for f in range(FILTERS):
            for half in (0, 1):
                col, b = half * FILTERS + f, arg[:, f] + half
                w[:, col] = g[:, f] @ e[rows, b]
                back = g[:, f, None] * p["filters"][None, :, col]
                np.add.at(de, x[rows, b].ravel(), back.reshape(-1, DIM))
        return out | {"filters": w, "embed": de}

    def fit(self, texts: list[list[bytes]], labels: np.ndarray, steps: int = STEPS, seed: int = 7) -> ByteCnn:
        """Fit on texts given as chunks of bytes (each up to a block longer than a chunk)."""
        keep = [i for i, t in enumerate(texts) if t]
        if not keep:
            return self
        texts, labels = [texts[i] for i in keep], labels[keep].astype(np.float32)
        self.p["base"][:] = np.log((labels.sum() + 1) / (len(labels) - labels.sum() + 1))
        rng, m = np.random.default_rng(seed), {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in self.p.items()}
        wide = CHUNK_BYTES + BLOCK
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(texts), BATCH)
            parts = [c for i in pick for c in texts[i]]
            doc = np.repeat(np.arange(BATCH), [len(texts[i]) for i in pick])
            x = np.frombuffer(b"".join(c.ljust(wide, b"\0") for c in parts), np.uint8).reshape(len(parts), -1, BLOCK)
            real = np.array([min(PIECES * PIECE, -(-len(c) // BLOCK)) for c in parts])
            rate = 0.01 * min(1, 2 * (1 - step / (steps + 1)))
            for k, g in self._gradient(x, real, doc, labels[pick]).items():
                a, b = m[k]
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                self.p[k] -= (rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        return self


def chunks_of(text: str | None) -> list[bytes]:
    """All chunks of a text on the grid that scoring uses, each with the block after it."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    step = STEP * PIECE * BLOCK
    n = max(0, -(-(len(raw) - CHUNK_BYTES) // step)) + 1 if raw else 0
    return [raw[i * step : i * step + CHUNK_BYTES + BLOCK] for i in range(n)]


def held_out(doc_id: str = "doc_id"):
    """Rows that nothing may be learned from."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))


def fit_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int | None = None) -> ByteCnn:
    """The network, fitted on labelled rows outside the held-out fifth: those of least hash, at most ``sample`` rows that together have at
    most ``sample_bytes`` (``SAMPLE_BYTES``) bytes. A text that is longer than that alone isn't learned from; another one that would
    exceed the bytes ends the sample.

    Sizes are summed before any text moves: the running sum sees numbers only, and only texts within the bound leave their tasks.
    """
    known = labels.where("doc_id is not null and quality is not null").where(~held_out())
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # at most ``sample`` rows of 12 bytes: their size is fixed
    most = SAMPLE_BYTES if sample_bytes is None else sample_bytes
    rows = texts.join(F.broadcast(known), "doc_id").where(F.octet_length("text").between(1, most))
    order = [F.xxhash64("doc_id"), F.col("doc_id"), F.col("quality"), F.col("h")]
    sizes = rows.select("doc_id", "quality", F.xxhash64("text").alias("h"), F.octet_length("text").cast("long").alias("size"))
    sizes = sizes.orderBy(*order).limit(sample).collect()  # ``sample`` rows of numbers
    taken, total = [], 0
    for r in sizes:
        total += r["size"]
        if total > most:
            break
        taken.append((r["doc_id"], r["quality"], r["h"]))
    if not taken:
        return ByteCnn()
    few = docs.sparkSession.createDataFrame(taken, "doc_id long, quality int, h long").distinct()
    found = texts.withColumn("h", F.xxhash64("text")).join(F.broadcast(few), ["doc_id", "h"])
    found = found.groupBy("doc_id", "quality", "h").agg(F.min("text").alias("text")).orderBy(*order).collect()
    return ByteCnn().fit([chunks_of(r["text"]) for r in found], np.array([r["quality"] for r in found]))


def score_quality(spark: SparkSession, docs: DataFrame, model: ByteCnn, score_col: str = "score") -> DataFrame:
    """``docs`` (all columns) with ``score_col``, which they must not have: the probability of label 1, over each whole text."""
    if score_col.lower() in {c.lower() for c in docs.columns}:
        raise ValueError(f"the rows have a column {score_col}")
    names = docs.columns
    at, shared = names.index("text"), spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, starts = text_bytes(batch.column(at))
            found = [shared.value.score(data[starts[i] : starts[j]], starts[i : j + 1] - starts[i]) for i, j in slices(starts, 1 << 17)]
            score = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score, pa.float64())], [*names, score_col])

    base = docs.select(*names)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema.fields) + f", `{score_col}` double"
    return base.mapInArrow(run, schema)


def op5_quality_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = score_quality(spark, docs.select("doc_id", "text"), model)
    # scores leave Python before anything filters or repeats them
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
