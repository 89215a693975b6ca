"""Quality classifier: a convolutional network over bytes, in numpy.

A document's UTF-8 bytes fall into overlapping chunks that cover all of it. In each chunk learned filters slide over
embedded bytes and their largest responses are kept (max pooling); the chunks' features are averaged, and a hidden
layer turns them into one probability. It is trained on the whole texts of a bounded sample of labelled documents and
scored over all.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulseward.llm.common import map_blocks

#: Labelled documents of each class that are trained on, the first by hash of id.
SAMPLE_PER_CLASS = 1500
CHUNK, OVERLAP, STEP = 512, 64, 4
EMBED, FILTERS, HIDDEN = 6, 24, 16
EPOCHS, BATCH, RATE, SEED = 14, 64, 0.01, 5
#: Chunks that are worked on at once.
CHUNK_BLOCK = 256


@dataclass
class Model:
    weights: dict[str, np.ndarray] | None
    prior: float

    def features(self, chunks: np.ndarray) -> np.ndarray:
        """Pooled filter responses of chunks (n, CHUNK) of bytes plus 1; 0 is padding."""
        w = self.weights
        out = np.empty((len(chunks), FILTERS), np.float32)
        for i in range(0, len(chunks), CHUNK_BLOCK):
            part = chunks[i : i + CHUNK_BLOCK]
            cells = w["embed"][part].reshape(len(part) * (CHUNK // STEP), STEP * EMBED)
            both = (cells @ w["conv"]).reshape(len(part), CHUNK // STEP, 2, FILTERS)
            out[i : i + len(part)] = (both[:, :-1, 0] + both[:, 1:, 1]).max(axis=1)
        return np.maximum(out + w["bias"], 0)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.weights is None:
            return np.full(len(texts), self.prior)
        chunks, counts = cut([(t or "").encode("utf-8", "surrogatepass") for t in texts])
        starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
        mean = np.add.reduceat(self.features(chunks), starts, axis=0) / counts[:, None]
        w = self.weights
        hidden = np.maximum(mean @ w["w1"] + w["b1"], 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ w["w2"] + w["b2"], -30, 30).astype(np.float64)))


def cut(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' overlapping chunks as rows of bytes plus 1, zero-padded, and chunks per text (at least one)."""
    stride = CHUNK - OVERLAP
    counts = np.array([max(1, -(-(len(t) - OVERLAP) // stride)) for t in texts], np.int64)
    out = np.zeros((int(counts.sum()), CHUNK), np.int16)
    row = 0
    for t, n in zip(texts, counts):
        padded = np.zeros((n - 1) * stride + CHUNK, np.int16)
        padded[: len(t)] = np.frombuffer(t, np.uint8).astype(np.int16) + 1
        out[row : row + n] = np.lib.stride_tricks.sliding_window_view(padded, CHUNK)[::stride]
        row += n
    return out, counts


def train(documents: list[tuple[bytes, int]], prior: float) -> Model:
    """Fit by Adam on (chunks of one document as rows of CHUNK bytes plus 1 in little-endian int16, label)."""
    labels = np.array([y for _, y in documents], np.float32)
    if not len(labels) or labels.min() == labels.max():
        return Model(None, prior)
    data = [np.frombuffer(d, "<i2").reshape(-1, CHUNK) for d, _ in documents]
    rng = np.random.default_rng(SEED)
    w = {
        "embed": rng.normal(0, 0.5, (257, EMBED)),
        "conv": rng.normal(0, 1 / np.sqrt(2 * STEP * EMBED), (STEP * EMBED, 2 * FILTERS)),
        "bias": np.zeros(FILTERS),
        "w1": rng.normal(0, 1 / np.sqrt(FILTERS), (FILTERS, HIDDEN)),
        "b1": np.zeros(HIDDEN),
        "w2": rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN),
        "b2": np.zeros(1),
    }
    w = {k: v.astype(np.float32) for k, v in w.items()}
    w["embed"][0] = 0
    first, second, step = ({k: np.zeros_like(v) for k, v in w.items()} for _ in range(2)), None, 0
    first, second = first
    for _ in range(EPOCHS):
        order = rng.permutation(len(data))
        for at in range(0, len(order), BATCH):
            batch = order[at : at + BATCH]
            grads = gradients(w, [data[i] for i in batch], labels[batch])
            step += 1
            for k, g in grads.items():
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g * g
                w[k] -= RATE * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-7)
            w["embed"][0] = 0
    # The sample holds the classes in other shares than the labels do.
    share = np.clip(labels.mean(), 1e-3, 1 - 1e-3)
    prior = np.clip(prior, 1e-3, 1 - 1e-3)
    w["b2"] += np.float32(np.log(prior / (1 - prior)) - np.log(share / (1 - share)))
    return Model(w, float(prior))


def gradients(w: dict[str, np.ndarray], docs: list[np.ndarray], y: np.ndarray) -> dict[str, np.ndarray]:
    chunks = np.concatenate(docs)
    counts = np.array([len(d) for d in docs])
    owner = np.repeat(np.arange(len(docs)), counts)
    n, cells = len(chunks), CHUNK // STEP
    best, top = np.empty((n, FILTERS), np.int64), np.empty((n, FILTERS), np.float32)
    for i in range(0, n, CHUNK_BLOCK):  # a batch with long texts has many chunks
        part = chunks[i : i + CHUNK_BLOCK]
        embedded = w["embed"][part].reshape(len(part) * cells, STEP * EMBED)
        both = (embedded @ w["conv"]).reshape(len(part), cells, 2, FILTERS)
        response = both[:, :-1, 0] + both[:, 1:, 1]
        at = response.argmax(axis=1)
        best[i : i + len(part)] = at
        top[i : i + len(part)] = np.take_along_axis(response, at[:, None], axis=1)[:, 0] + w["bias"]
    pooled = np.maximum(top, 0)
    mean = np.add.reduceat(pooled, np.concatenate(([0], np.cumsum(counts)[:-1])), axis=0) / counts[:, None]
    before = mean @ w["w1"] + w["b1"]
    hidden = np.maximum(before, 0)
    p = 1 / (1 + np.exp(-np.clip(hidden @ w["w2"] + w["b2"], -30, 30)))
    d = ((p - y) / len(y)).astype(np.float32)
    d_before = np.outer(d, w["w2"]) * (before > 0)
    d_pooled = (d_before @ w["w1"].T / counts[:, None])[owner] * (top > 0)
    # Only the window that won a filter's pooling takes part.
    rows, cell_bytes = np.arange(n)[:, None], chunks.reshape(n, cells, STEP)
    of_cell = lambda at: w["embed"][cell_bytes[rows, at]].reshape(n, FILTERS, STEP * EMBED)
    left, right = of_cell(best), of_cell(best + 1)
    d_left = np.einsum("nf,nfe->ef", d_pooled, left)
    d_right = np.einsum("nf,nfe->ef", d_pooled, right)
    d_embed = np.zeros_like(w["embed"])
    for half, at in ((w["conv"][:, :FILTERS], best), (w["conv"][:, FILTERS:], best + 1)):
        back = (d_pooled[:, :, None] * half.T[None]).reshape(-1, EMBED)
        np.add.at(d_embed, cell_bytes[rows, at].reshape(-1), back)
    return {
        "embed": d_embed,
        "conv": np.concatenate((d_left, d_right), axis=1),
        "bias": d_pooled.sum(axis=0),
        "w1": mean.T @ d_before,
        "b1": d_before.sum(axis=0),
        "w2": hidden.T @ d,
        "b2": d.sum(keepdims=True),
    }


def held_out(doc_id: Column) -> Column:
    """Documents no label is learned from; a null id is not held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Train on up to ``per_class`` labelled documents of each class that are not held out, the first by hash of id.

    Labels other than 0 and 1 and null ids are ignored; an id labelled twice counts by its largest label.
    Without both classes the model gives every document the share of label 1 (0.5 without labels).
    """
    known = (
        labels.where(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull())
        .where(~held_out(F.col("doc_id")))
        .groupBy("doc_id")
        .agg(F.max(F.col(label).cast("int")).alias("y"))
    )
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}  # two rows at most
    total = sum(sizes.values())
    prior = sizes.get(1, 0) / total if total else 0.5
    if len(sizes) < 2:
        return Model(None, prior)
    # A limit after a sort keeps each task's first rows, so that no class is gathered in one task.
    by_hash = known.withColumn("place", F.md5(F.col("doc_id").cast("string")))
    samples = [by_hash.where(F.col("y") == y).orderBy("place", "doc_id").limit(per_class) for y in (0, 1)]
    texts = docs.select("doc_id", "text").join(F.broadcast(samples[0].union(samples[1]).select("doc_id", "y", "place")), "doc_id")

    def chunks_of(part: pa.RecordBatch) -> dict:
        out = []
        for t in part.column("text").to_pylist():
            rows, _ = cut([(t or "").encode("utf-8", "surrogatepass")])
            out.append(rows.astype("<i2").tobytes())
        return {"chunks": pa.array(out, pa.binary()), "y": part.column("y"), "place": part.column("place")}

    # Bounded: 2 * per_class documents, each with its whole text.
    found = map_blocks(texts, chunks_of, "chunks binary, y int, place string").collect()
    found.sort(key=lambda r: (r["place"], r["y"], r["chunks"]))
    return train([(bytes(r["chunks"]), r["y"]) for r in found], prior)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` as (doc_id, held_out, score, predicted); null texts score as empty ones.

    Rows that repeat an id or a text are scored each; other columns, of whatever names, are ignored.
    """

    def scored(part: pa.RecordBatch) -> dict:
        p = model.score(part.column("text").to_pylist())
        return {"doc_id": part.column("doc_id"), "score": pa.array(p, pa.float64())}

    out = map_blocks(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), scored, "doc_id long, score double")
    return out.select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that score 0.5 or more, with all their columns."""

    @F.pandas_udf("double")
    def quality(text):
        import pandas as pd

        parts = np.array_split(np.arange(len(text)), max(1, sum(len(t or "") for t in text) >> 20))
        return pd.Series(np.concatenate([model.score(list(text.iloc[i])) for i in parts if len(i)] or [np.zeros(0)]))

    return docs.where(quality(F.col("text")) >= 0.5)
