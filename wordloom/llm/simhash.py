"""SimHash near-duplicates by covering locality-sensitive hashing (operator 10).

Each bit of a fingerprint gets a random vector of ``RADIUS + 1`` bits.  For every
non-zero vector v of as many bits there is a table whose mask holds the bits
whose vectors have an odd product with v.  Two fingerprints that differ in at
most ``RADIUS`` bits agree under some mask: their differing bits' vectors span
less than the whole space, so some v is orthogonal to all of them.  Hence all
links are found, whatever the random vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored
from .components import connected_components
from .tiles import least_labels, over_tiles, tiled

RADIUS, WORDS, SEED = 3, 3, 42


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """The SimHash of a text's word shingles, as an unsigned integer; 0 without words."""
    from xxhash import xxh64_intdigest

    found = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not found:
        return 0
    joined = b" ".join(found)
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = [0, *(ends[:-1] + 1).tolist()]
    last = ends[words - 1 :].tolist() or [len(joined)]
    return majority(np.fromiter((xxh64_intdigest(joined[a:b], SEED) for a, b in zip(starts, last, strict=False)), np.uint64, len(last)))


def majority(hashes: np.ndarray) -> int:
    """The fingerprint of shingles' hashes, as ``fingerprint`` makes it."""
    bits = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 50_000):
        bits += np.unpackbits(hashes[i : i + 50_000].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * bits > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fp) for each row: the fingerprint as a signed 64-bit integer; null texts have no words."""

    def make():
        def step(batch: dict | None) -> Iterator[dict]:
            if batch:
                yield {key: batch[key], "fp": [x - (1 << 64) if (x := fingerprint(t)) >> 63 else x for t in batch[text]]}

        return step

    return map_batches(docs.select(key, text), make, f"{key} {docs.schema[key].dataType.simpleString()}, fp long")


def covering_masks(radius: int = RADIUS, seed: int = 7) -> list[int]:
    """The masks of the tables, as unsigned 64-bit integers."""
    vectors = np.random.default_rng(seed).integers(0, 1 << (radius + 1), 64)
    return [sum(1 << i for i, x in enumerate(vectors.tolist()) if bin(x & v).count("1") % 2) for v in range(1, 1 << (radius + 1))]


def near_edges(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) whose components are those of all pairs of distinct ``fp`` within ``radius`` bits."""
    masks = [m - (1 << 64) if m >> 63 else m for m in covering_masks(radius)]
    keys = F.explode(F.array(*[F.struct(F.lit(i).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for i, m in enumerate(masks)]))
    rows = fps.select("fp", keys.alias("x")).select("x.t", "x.k", "fp")

    def each(tile: dict[str, np.ndarray]) -> dict | None:
        fp = tile["fp"]
        u = fp.view(np.uint64)
        label = least_labels(np.bitwise_count(u[:, None] ^ u[None, :]) <= radius)
        hung = np.flatnonzero(label != np.arange(len(fp)))
        return {"a": fp[hung], "b": fp[label[hung]]} if len(hung) else None

    return over_tiles(tiled(rows, ["t", "k"], "fp"), ["t", "k"], ["fp"], each, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row.

    Texts without words, null ones included, have fingerprint zero and link
    like any other.  Repeated rows give a row each; null doc_ids are grouped
    but never name a component unless it holds nothing else.
    """
    prints = stored(fingerprints(docs), "prints")
    classes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "classes")
    parts = stored(connected_components(near_edges(classes.select("fp"))), "parts").withColumnRenamed("node", "fp")
    named = classes.join(parts, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    least = stored(named.groupBy("component").agg(F.min("least").alias("component_id")), "least")
    owners = stored(named.join(least, "component").select("fp", "component_id"), "owners")
    return prints.join(owners, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
