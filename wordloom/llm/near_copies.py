"""Groups of texts whose word shingles are alike, for the pipeline.

The similarity of two texts is the Jaccard index of their sets of ``WORDS``-word
shingles.  Candidates come from operator 10: the sets' SimHash fingerprints under
its covering masks, which find every pair within ``simhash.RADIUS`` bits.  As
few pairs at 0.8 are that near, ``BANDS`` keys of ``ROWS`` least hashes each find
more: a pair at the threshold of 0.8 shares a key with a probability of 0.9999,
a pair at 0.9 misses all with one below 1e-10.  Candidates are links only if
their sets prove it.  Each text is first held against the least text of its keys' groups;
groups which that leaves in several parts are compared pair by pair, in blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chained_passages import word_hashes
from .common import map_batches, stored
from .components import connected_components
from .simhash import covering_masks, majority
from .tiles import least_labels, over_tiles, tiled

WORDS, LEAST, BANDS, ROWS, SEED = 5, 0.8, 32, 6, 42
TOGETHER = 20_000
"""Shingles, about, that are hashed at once, so that they stay in the cache."""
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h * _MIX
    return h ^ (h >> np.uint64(29))


def shingles(words: np.ndarray) -> np.ndarray:
    """The different shingles' hashes, sorted; fewer than ``WORDS`` words are one shingle, no words none."""
    size = min(WORDS, len(words))
    if not size:
        return np.zeros(0, np.uint64)
    n = len(words) - size + 1
    h = np.full(n, size, np.uint64)
    for i in range(size):
        h = _mixed(h ^ words[i : i + n])
    return np.unique(_mixed(h))


def _digest(found: np.ndarray) -> int:
    from xxhash import xxh3_64_intdigest

    x = xxh3_64_intdigest(found.tobytes(), SEED)
    return x - (1 << 64) if x >> 63 else x


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of ``BANDS`` keys for each set; empty sets share theirs."""
    rng = np.random.default_rng(SEED)
    flips, factors = rng.integers(0, 1 << 63, (2, BANDS * ROWS), dtype=np.uint64)
    factors |= np.uint64(1)
    sets = [s if len(s) else np.zeros(1, np.uint64) for s in sets]
    out = np.zeros((len(sets), BANDS), np.uint64)
    ends = np.cumsum([len(s) for s in sets])
    at = 0
    while at < len(sets):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TOGETHER, "right")))
        some = sets[at:to]
        joined = np.concatenate(some)
        starts = np.concatenate([[0], np.cumsum([len(s) for s in some])[:-1]])
        for band in range(BANDS):
            key = np.full(len(some), band, np.uint64)
            for k in range(band * ROWS, (band + 1) * ROWS):
                key = _mixed(key ^ np.minimum.reduceat((joined ^ flips[k]) * factors[k], starts))
            out[at:to, band] = key
        at = to
    return out.view(np.int64)


def covering_keys(sets: list[np.ndarray]) -> np.ndarray:
    """A row of keys for each set, one for each covering mask: its fingerprint as far as the mask shows it."""
    prints = np.array([majority(s) if len(s) else 0 for s in sets], np.uint64)[:, None]
    masks = np.array(covering_masks(), np.uint64)[None, :]
    table = np.arange(1, masks.shape[1] + 1, dtype=np.uint64)[None, :]
    return _mixed(_mixed(prints & masks) ^ (table * _MIX)).view(np.int64)


def alike(a: np.ndarray, b: np.ndarray, least: float = LEAST) -> bool:
    """Whether two sorted sets reach the similarity; two empty ones do."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= least * (len(a) + len(b) - both)


def links(sets: list[np.ndarray], least: float = LEAST) -> np.ndarray:
    """The symmetric matrix of the sets that are alike."""
    sizes = np.array([len(s) for s in sets])
    both = np.zeros((len(sets), len(sets)), np.float32)
    _, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(codes, kind="stable")
    codes, owner = codes[order], owner[order]
    width = 8192
    for lo in range(0, int(codes[-1]) + 1 if len(codes) else 0, width):
        i, j = np.searchsorted(codes, [lo, lo + width])
        held = np.zeros((len(sets), width), np.float32)
        held[owner[i:j], codes[i:j] - lo] = 1
        both += held @ held.T
    return both >= least * (sizes[:, None] + sizes[None, :] - both.astype(np.float64))


def _keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, body, keys) for each row; a mark names its doc_id and text, a body its set of shingles."""

    def make():
        def step(batch: dict | None) -> Iterator[dict]:
            if batch:
                for lo in range(0, len(batch["text"]), 1000):
                    sets = [shingles(w) for w in word_hashes(batch["text"][lo : lo + 1000])]
                    yield {"doc_id": batch["doc_id"][lo : lo + 1000], "mark": batch["mark"][lo : lo + 1000], "body": [_digest(s) for s in sets], "keys": list(np.concatenate([covering_keys(sets), band_keys(sets)], axis=1))}

        return step

    return map_batches(marked(docs), make, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, mark long, body long, keys array<long>")


def marked(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.xxhash64("doc_id", "text").alias("mark"), "text")


def _sets(docs: DataFrame, owners: DataFrame) -> DataFrame:
    """(body, set) for each (mark, body) of ``owners``."""

    def make():
        def step(batch: dict | None) -> Iterator[dict]:
            if batch:
                for lo in range(0, len(batch["text"]), 1000):
                    sets = [shingles(w) for w in word_hashes(batch["text"][lo : lo + 1000])]
                    own = [(b, s.tobytes()) for b, s in zip(batch["body"][lo : lo + 1000], sets, strict=True) if _digest(s) == b]
                    if own:
                        yield dict(zip(("body", "set"), map(list, zip(*own, strict=True)), strict=True))

        return step

    met = marked(docs).join(owners.hint("shuffle_hash"), "mark").select("body", "text")
    # Repeated rows give the same set again.
    return map_batches(met, make, "body long, set binary").dropDuplicates(["body"])


def _to_least(groups: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) of the texts that are alike the least text of a group of theirs."""
    first = groups.groupBy("key").agg(F.min("body").alias("first"))
    pairs = stored(groups.join(first, "key").where("body <> first").select("body", "first").distinct(), "pairs")
    met = pairs.join(sets, "body").join(sets.select(F.col("body").alias("first"), F.col("set").alias("other")), "first")

    def make():
        def step(batch: dict | None) -> Iterator[dict]:
            if batch:
                near = [(a, b) for a, b, x, y in zip(batch["body"], batch["first"], batch["set"], batch["other"], strict=True) if alike(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), least)]
                if near:
                    yield dict(zip(("a", "b"), map(list, zip(*near, strict=True)), strict=True))

        return step

    return map_batches(met.select("body", "first", "set", "other"), make, "a long, b long")


def _among(groups: DataFrame, parts: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Edges (a, b) that unite the texts that are alike in the groups which ``parts`` leave apart."""
    named = stored(groups.join(parts.withColumnRenamed("node", "body"), "body", "left").select("key", "body", F.coalesce("component", "body").alias("component")), "named")
    apart = stored(named.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key"), "apart")
    tiles = tiled(named.join(apart, "key").select("key", "body"), ["key"], "body").join(sets, "body")

    def each(tile: dict[str, np.ndarray]) -> dict | None:
        body = tile["body"]
        label = least_labels(links([np.frombuffer(x, np.uint64) for x in tile["set"]], least))
        hung = np.flatnonzero(label != np.arange(len(body)))
        return {"a": body[hung], "b": body[label[hung]]} if len(hung) else None

    return over_tiles(tiles, ["key"], ["body", "set"], each, "a long, b long")


def groups_of(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, mark, component_id, kept) for each row: the smallest doc_id that links of similarity ``least`` reach.

    ``mark`` is a hash of doc_id and text.  Of each component the rows with the least
    doc_id, and among these with the least mark, are kept; rows without a
    doc_id come after all others.  ``least`` below ``LEAST`` is found less often, as
    the keys are made for it.  Texts without words, null ones included, are alike.
    """
    keyed = stored(_keyed(docs), "prints")
    place = F.struct(F.col("doc_id").isNull().alias("without"), "doc_id", "mark")
    classes = stored(keyed.groupBy("body").agg(F.min(place).alias("least"), F.min("keys").alias("keys")), "classes")
    rows = classes.select("body", F.explode("keys").alias("key"))
    shared = rows.groupBy("key").agg(F.count("*").alias("n"), F.bit_xor("body").alias("x"), F.bit_xor(F.xxhash64("body")).alias("y")).where("n > 1")
    once = stored(shared.groupBy("n", "x", "y").agg(F.min("key").alias("key")).select("key"), "groups")  # the same texts often share several keys
    groups = stored(rows.join(once, "key"), "groups")
    owners = stored(groups.select("body").distinct().join(classes.select("body", F.col("least.mark").alias("mark")), "body"), "owners")
    sets = stored(_sets(docs, owners), "sets")
    edges = stored(_to_least(groups, sets, least), "edges")
    parts = stored(connected_components(edges), "parts")
    more = stored(_among(groups, parts, sets, least), "edges")
    if not more.isEmpty():
        parts = stored(connected_components(edges.unionByName(more)), "parts")
    named = classes.join(parts.withColumnRenamed("node", "body"), "body", "left").select("body", "least", F.coalesce("component", "body").alias("component"))
    named = stored(named, "named")
    owned = stored(named.join(named.groupBy("component").agg(F.min("least").alias("first")), "component").select("body", "first"), "owned")
    kept = F.col("mark") == F.col("first.mark")
    return keyed.select("doc_id", "mark", "body").join(owned, "body").select("doc_id", "mark", F.col("first.doc_id").alias("component_id"), kept.alias("kept"))
