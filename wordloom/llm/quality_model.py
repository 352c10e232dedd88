"""Quality classifier: a byte-level convolutional network in NumPy (operator 1).

A filter reads ``WIDTH`` bytes: it adds a learned number for each byte at each
place.  Its largest value in every chunk of ``CHUNK`` bytes counts; chunks overlap
by half and cover the whole text.  The mean and the maximum of these over the
chunks, weighted and added, give the probability.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

FILTERS, WIDTH, CHUNK = 12, 5, 256
SAMPLE = 600
"""Most labelled rows of each label that the network learns from."""
SAMPLE_BYTES = 59_904
"""Bytes of a labelled text that the network learns from: of a longer one, two chunks at a time at even distances over the whole of it (scoring reads all)."""
EPOCHS, BATCH, RATE = 14, 24, 0.03
PIECE = 1 << 19
"""Bytes of a text that are read at once; pieces overlap so that no chunk is lost."""


@dataclass
class Network:
    table: np.ndarray  # (WIDTH, 256, FILTERS)
    bias: np.ndarray  # (FILTERS,)
    weights: np.ndarray  # (2, FILTERS): of the mean and of the maximum
    offset: float

    def halves(self, data: np.ndarray) -> np.ndarray:
        """The largest value of each filter among the places that start in each half chunk."""
        half = CHUNK // 2
        padded = np.concatenate([data, np.zeros(WIDTH - 1, np.uint8)])
        values = self.table[0].take(padded[: len(data)], axis=0)
        for k in range(1, WIDTH):
            values += self.table[k].take(padded[k : k + len(data)], axis=0)
        return np.maximum.reduceat(values, np.arange(0, len(data), half), axis=0)

    def pooled(self, text: bytes) -> np.ndarray:
        """(2, FILTERS): the mean and the maximum over chunks of what remains above zero."""
        if not text:
            return np.zeros((2, FILTERS), np.float32)
        data = np.frombuffer(text, np.uint8)
        halves = []
        for at in range(0, len(data), PIECE):
            part = data[at : at + PIECE + WIDTH - 1]
            halves.append(self.halves(part)[: -(-min(PIECE, len(data) - at) // (CHUNK // 2))])
        h = np.concatenate(halves)
        chunks = np.maximum(h[:-1], h[1:]) if len(h) > 1 else h
        active = np.maximum(chunks + self.bias, 0)
        return np.stack([active.mean(axis=0), active.max(axis=0)])

    def score(self, text: str | None) -> float:
        """The probability of label 1; a null text counts as empty."""
        z = float((self.pooled((text or "").encode("utf-8", "surrogatepass")) * self.weights).sum() + self.offset)
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def train(texts: list[bytes], labels: list[int], prior: float, seed: int = 5) -> Network:
    """Fit the network by Adam steps on the logistic loss; each label weighs half, then ``prior`` sets the offset."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.1, (WIDTH, 256, FILTERS)).astype(np.float32), np.zeros(FILTERS, np.float32), rng.normal(0, 0.3, (2, FILTERS)).astype(np.float32), 0.0)
    y = np.array(labels, np.float64)
    share = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    if not len(y) or y.min() == y.max():
        net.weights[:] = 0
        net.offset = float(np.log(prior / (1 - prior)))
        return net
    params = {"table": net.table, "bias": net.bias, "weights": net.weights, "offset": np.zeros(1)}
    moments = {k: (np.zeros(v.shape), np.zeros(v.shape)) for k, v in params.items()}
    half, step = CHUNK // 2, 0
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for lo in range(0, len(order), BATCH):
            grads = {k: np.zeros(v.shape) for k, v in params.items()}
            chosen = order[lo : lo + BATCH]
            for i in chosen.tolist():
                if not texts[i]:  # scored by the offset alone
                    z = float(params["offset"][0])
                    grads["offset"] += (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[i]) * share[i] / len(chosen)
                    continue
                data = np.frombuffer(texts[i], np.uint8)
                padded = np.concatenate([data, np.zeros(WIDTH - 1, np.uint8)])
                values = net.table[0].take(data, axis=0)
                for k in range(1, WIDTH):
                    values += net.table[k].take(padded[k : k + len(data)], axis=0)
                blocks = -(-len(data) // half)
                grid = np.full((blocks * half, FILTERS), -np.inf, np.float32)
                grid[: len(data)] = values
                grid = grid.reshape(blocks, half, FILTERS)
                where = grid.argmax(axis=1)
                h = np.take_along_axis(grid, where[:, None], axis=1)[:, 0]
                place = where + (np.arange(blocks) * half)[:, None]
                if blocks > 1:
                    second = h[1:] > h[:-1]
                    chunks, at = np.where(second, h[1:], h[:-1]), np.where(second, place[1:], place[:-1])
                else:
                    chunks, at = h, place
                active = np.maximum(chunks + net.bias, 0)
                top = active.argmax(axis=0)
                pooled = np.stack([active.mean(axis=0), active[top, np.arange(FILTERS)]])
                z = float((pooled * net.weights).sum() + params["offset"][0])
                error = (1 / (1 + np.exp(-np.clip(z, -60, 60))) - y[i]) * share[i] / len(chosen)
                grads["weights"] += error * pooled
                grads["offset"] += error
                back = np.repeat(error * net.weights[:1] / len(active), len(active), axis=0)
                back[top, np.arange(FILTERS)] += error * net.weights[1]
                back = np.where(active > 0, back, 0)
                grads["bias"] += back.sum(axis=0)
                filters = np.broadcast_to(np.arange(FILTERS), at.shape)
                for k in range(WIDTH):
                    np.add.at(grads["table"][k], (padded[at + k], filters), back)
            step += 1
            rate = RATE * (1 - epoch / EPOCHS)
            for k, v in params.items():
                m, s = moments[k]
                g = grads[k] + (1e-4 * v if k != "offset" else 0)
                m += 0.1 * (g - m)
                s += 0.01 * (g * g - s)
                v -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-8)).astype(v.dtype)
    net.offset = float(params["offset"][0] + np.log(prior / (1 - prior)))
    return net


def held_out(doc_id: str = "doc_id"):
    """Whether a row is kept from training: crc32 of the doc_id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame) -> Network:
    """Learn from at most ``SAMPLE`` documents of each label, chosen by a hash of doc_id among those not held out.

    Documents with both labels are left out; of rows that share a doc_id the
    one with the least text counts.
    """
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.min("quality").cast("int").alias("quality"), F.max("quality").cast("int").alias("_other")).where("quality = _other").drop("_other")
    counts = {r["quality"]: r["n"] for r in known.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = [r for q in (0, 1) for r in known.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE).collect()]
    prior = (counts.get(1, 0) + 1) / (sum(counts.values()) + 2)
    if not chosen:
        return train([], [], prior)
    wanted = docs.sparkSession.createDataFrame(chosen, known.schema)
    found = docs.select("doc_id", F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("bytes")).join(F.broadcast(wanted), "doc_id")
    rows = found.select("doc_id", "quality", spread(F.col("bytes")).alias("bytes")).groupBy("doc_id", "quality").agg(F.min("bytes").alias("bytes")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return train([bytes(r["bytes"]) for r in rows], [r["quality"] for r in rows], prior)


def spread(data):
    """``SAMPLE_BYTES`` of a binary column, two chunks at a time at even distances from its start to its end; all of a shorter one."""
    piece = 2 * CHUNK
    many = SAMPLE_BYTES // piece
    step = (F.length(data) - piece) / (many - 1)
    pieces = F.transform(F.sequence(F.lit(0), F.lit(many - 1)), lambda i: F.substring(data, F.floor(i * step).cast("int") + 1, F.lit(piece)))
    return F.when(F.length(data) <= SAMPLE_BYTES, data).otherwise(F.aggregate(pieces, F.lit(b""), lambda s, x: F.concat(s, x)))


def scored(docs: DataFrame, net: Network) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row; null and empty texts get the score of an empty text."""

    def make():
        def step(batch: dict | None) -> Iterator[dict]:
            if batch:
                s = [net.score(t) for t in batch["text"]]
                yield {"doc_id": batch["doc_id"], "held_out": batch["held_out"], "score": s, "predicted": [int(x >= 0.5) for x in s]}

        return step

    return map_batches(docs.select("doc_id", held_out().alias("held_out"), "text"), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Fit on the labelled rows that are not held out, and score every row of ``docs``.

    Labels other than 0 and 1 are left out; without both labels every score is
    the share of label 1 among them.  Repeated rows score alike; an empty table
    gives no rows; extra columns play no part.
    """
    return scored(docs, fit(docs, labels))
