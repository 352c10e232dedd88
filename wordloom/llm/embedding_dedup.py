"""Embedding near-duplicates by sorted projection passes (operator 6).

In each pass every vector gets a key of concatenated random hashes, the signs of
random projections.  Vectors are put in the order of their keys, each is
compared with a window of those that follow it, those in the next range of the
sorted table among them, and pairs of a cosine of at least the threshold are
united over all passes.  Equal vectors are one row from the start.  The number
of links is then counted exactly within each component, block by block, so
groups larger than the window lose none.

How many passes a label needs, and how wide a window, follows from its size and
from how close its vectors lie to each other anyway (``effort``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches, stored
from .components import connected_components
from .tiles import over_tiles, tiled

COSINE, PASSES, BITS, NEIGHBOURS = 0.98, 12, 62, 32
"""Passes and neighbours are those of a label of ``SMALL`` vectors that point in all directions."""
SMALL = 10_000


def effort(n: int, mean: float, cosine: float = COSINE, passes: int = PASSES, neighbours: int = NEIGHBOURS) -> tuple[int, int]:
    """(passes, neighbours) for a label of ``n`` vectors of a ``mean`` cosine.

    The window doubles with every fourfold size, and once or twice where the
    distance of a link is no longer small (a seventh, a third) against the mean
    distance; passes grow by half of their number each time that the size or the
    window so doubles.
    """
    doublings = max(0, int(np.ceil(np.log2(max(n, 1) / SMALL))))
    share = (1 - cosine) / max(1 - mean, 1e-9)
    steps = int(share >= 1 / 7) + int(share >= 1 / 3)
    return int(passes * (1 + (steps + doublings) / 2)), neighbours << (steps + (doublings + 1) // 2)


def unit(vectors: np.ndarray) -> np.ndarray:
    """The vectors in double precision, scaled to length one."""
    x = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _vectors(column) -> np.ndarray:
    joined = b"".join(column)
    return np.frombuffer(joined, np.float64).reshape(len(column), -1)


def distinct_vectors(rows: DataFrame, vector: str, group: str) -> DataFrame:
    """(node, label, dim, h1, h2, least, copies, vec): each different vector of a label once."""
    named = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(group).alias("label"), F.col(vector).cast("array<double>").alias("v"))
    fine = F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: F.coalesce(x, F.lit(0.0)) != 0)
    keyed = named.where(F.coalesce(fine, F.lit(False))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0))).withColumns({"dim": F.size("v"), "h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v")})
    once = keyed.groupBy("label", "dim", "h1", "h2").agg(F.min("vec_id").alias("least"), F.count("*").alias("copies"), F.min("v").alias("v")).withColumn("node", F.monotonically_increasing_id())

    def make():
        def step(batch: dict | None) -> Iterator[dict]:
            if batch:
                yield {k: batch[k] for k in ("node", "label", "dim", "h1", "h2", "least", "copies")} | {"vec": [unit(np.array([v], np.float64)).tobytes() for v in batch["v"]]}

        return step

    kind = once.schema["label"].dataType.simpleString()
    return stored(map_batches(once, make, f"node long, label {kind}, dim int, h1 long, h2 long, least long, copies long, vec binary"), "vectors")


def _efforts(nodes: DataFrame, cosine: float, passes: int, neighbours: int) -> DataFrame:
    """(label, dim, passes, neighbours) for each label: from its size and the length of its mean vector, whose square is the mean cosine."""
    kind = nodes.schema["label"].dataType.simpleString()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                coded = part["label"].dictionary_encode()
                sums = np.zeros((len(coded.dictionary), dim))
                np.add.at(sums, coded.indices.to_numpy(), _vectors(part["vec"].to_pylist()))
                many = np.bincount(coded.indices.to_numpy(), minlength=len(sums))
                at = np.tile(np.arange(dim, dtype=np.int32), len(sums))
                labels = coded.dictionary.take(pa.array(np.repeat(np.arange(len(sums)), dim)))
                yield pa.RecordBatch.from_arrays([labels, pa.array(np.full(len(at), dim, np.int32)), pa.array(at), pa.array(sums.ravel()), pa.array(np.repeat(many, dim))], names=["label", "dim", "at", "x", "n"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [effort(n, square / n**2, cosine, passes, neighbours) for n, square in zip(batch["n"].to_pylist(), batch["square"].to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch["label"], batch["dim"], *(pa.array([e[k] for e in each], pa.int32()) for k in (0, 1))], names=["label", "dim", "passes", "neighbours"])

    parts = nodes.select("label", "dim", "vec").mapInArrow(add, f"label {kind}, dim int, at int, x double, n long")
    means = parts.groupBy("label", "dim", "at").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    sizes = means.groupBy("label", "dim").agg(F.max("n").alias("n"), F.sum(F.col("x") * F.col("x")).alias("square"))
    return stored(sizes.mapInArrow(choose, f"label {kind}, dim int, passes int, neighbours int"), "efforts")


def pass_edges(nodes: DataFrame, cosine: float = COSINE, passes: int = PASSES, bits: int = BITS, neighbours: int = NEIGHBOURS, seed: int = 11) -> DataFrame:
    """Edges (a, b) that unite what the passes' windows link; passes and neighbours are those of ``effort`` for each label."""
    kind = nodes.schema["label"].dataType.simpleString()
    efforts = _efforts(nodes, cosine, passes, neighbours)
    most = efforts.agg(F.max("passes"), F.max("neighbours")).first()
    passes, neighbours = (most[0] or passes), (most[1] or neighbours)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)
        for batch in batches:
            dims = batch["dim"].to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                x = _vectors(part["vec"].to_pylist())
                if dim not in planes:
                    planes[dim] = np.random.default_rng(seed).standard_normal((dim, passes * bits))
                own = part["passes"].to_numpy()
                for p in range(int(own.max())):
                    some = part.filter(pa.array(own > p))
                    key = (x[own > p] @ planes[dim][:, p * bits : (p + 1) * bits] > 0) @ weights
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), p, np.int32)), some["label"], some["dim"], pa.array(key), *(some[c] for c in ("node", "neighbours", "vec"))], names=["pass", "label", "dim", "key", "node", "neighbours", "vec"])

    order = ["seam", "pass", "label", "dim", "key", "node"]

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])
        held: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            fresh = pa.Table.from_batches([batch])
            t = fresh if held is None else pa.concat_tables([held, fresh])
            of = {c: t[c].to_numpy() for c in (*order[:4], "node", "neighbours")}
            apart = np.zeros(max(0, t.num_rows - 1), bool)
            for c in order[:4]:
                apart |= of[c][1:] != of[c][:-1]
            same = np.cumsum(np.concatenate([[False], apart]))
            vecs = t["vec"].to_pylist()
            label = np.arange(t.num_rows)
            for g in np.unique(same).tolist():
                lo, hi = np.searchsorted(same, [g, g + 1]).tolist()
                x = _vectors(vecs[lo:hi])
                pairs = []
                for off in range(1, min(int(of["neighbours"][lo]), hi - lo - 1) + 1):
                    i = np.flatnonzero(np.einsum("ij,ij->i", x[:-off], x[off:]) >= cosine)
                    pairs.append(np.stack([i, i + off]) + lo)
                if pairs:
                    i, j = np.concatenate(pairs, axis=1)
                    while True:
                        least = np.minimum(label[i], label[j])
                        new = label.copy()
                        np.minimum.at(new, i, least)
                        np.minimum.at(new, j, least)
                        new = new[new]
                        if (new == label).all():
                            break
                        label = new
            hung = np.flatnonzero(label != np.arange(len(label)))
            if len(hung):
                yield pa.RecordBatch.from_arrays([pa.array(of["node"][hung]), pa.array(of["node"][label[hung]])], schema=schema)
            held = t.slice(max(0, t.num_rows - neighbours)).combine_chunks()

    keyed = nodes.select("node", "label", "dim", "vec").join(efforts, ["label", "dim"]).mapInArrow(keys, f"pass int, label {kind}, dim int, key long, node long, neighbours int, vec binary")
    ranges = stored(keyed, "keys").repartitionByRange(*order[1:]).sortWithinPartitions(*order[1:]).withColumn("seam", F.spark_partition_id())
    columns = ranges.columns

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Edges, and beside them the rows at the ends of the range."""
        ends, names = _Ends(neighbours), ["a", "b", *columns]

        def watched() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    ends.add(batch)
                    yield batch

        for found in compare(watched()):
            yield pa.RecordBatch.from_arrays([*found.columns, *(pa.nulls(found.num_rows, t) for t in ends.types)], names=names)
        for t in ends.rows():
            nothing = pa.nulls(t.num_rows, pa.int64())
            yield from pa.Table.from_arrays([nothing, nothing, *(t[c] for c in columns)], names=names).combine_chunks().to_batches()

    made = stored(ranges.mapInArrow(both, "a long, b long, " + ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranges.schema)), "compared")
    # Rows within a window of a range's end meet those on the other side of the seam.
    across = made.where("a is null").select(*columns).repartition("seam").sortWithinPartitions(*order).mapInArrow(compare, "a long, b long")
    return made.where("a is not null").select("a", "b").unionByName(across)


class _Ends:
    """The first and the last ``size`` rows of a range, for the seams before and after it; a shorter range goes to one seam more."""

    def __init__(self, size: int):
        self.size, self.seen = size, 0
        self.first: list[pa.Table] = []
        self.last: pa.Table | None = None
        self.types: list[pa.DataType] = []

    def add(self, batch: pa.RecordBatch) -> None:
        t = pa.Table.from_batches([batch])
        self.types = t.schema.types
        if self.seen < self.size:
            self.first.append(t.slice(0, self.size - self.seen))
        self.seen += t.num_rows
        joined = t if self.last is None else pa.concat_tables([self.last, t])
        self.last = joined.slice(max(0, joined.num_rows - self.size)).combine_chunks()

    def rows(self) -> Iterator[pa.Table]:
        if self.last is None:
            return
        own = self.last["seam"][0].as_py()
        seams = [(self.first, own - 1), ([self.last], own)] + ([([self.last], own - 2)] if self.seen < self.size else [])
        for parts, seam in seams:
            t = pa.concat_tables(parts)
            yield t.set_column(t.schema.get_field_index("seam"), "seam", pa.array(np.full(t.num_rows, seam, np.int32)))


def linked(rows: DataFrame, vector: str = "embedding", group: str = "label", cosine: float = COSINE) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of ``rows``.

    Only vectors of one label and one length are compared.  Vectors that are
    null, empty, zero or hold a null or non-finite component, and rows without a
    label, link with nothing.  Equal vectors, repeated rows among them, link with each
    other; a null vec_id names no component unless it is alone in it.
    """
    nodes = distinct_vectors(rows, vector, group)
    parts = stored(connected_components(pass_edges(nodes, cosine)), "parts")
    grouped = parts.join(nodes.select("node", "copies", "vec"), "node")

    def count(tile: dict[str, np.ndarray]) -> dict | None:
        x, copies, own, node = _vectors(tile["vec"]), tile["copies"], tile["own"], tile["node"]
        near = x @ x.T >= cosine
        if (own != own[0]).any():  # two blocks: pairs across them
            near &= own[:, None] != own[None, :]
        elif tile["bi"][0] != tile["bj"][0]:
            return None
        else:
            np.fill_diagonal(near, False)
        return {"node": node, "links": near @ copies}

    tiles = tiled(grouped, ["component"], "node").withColumns({"bi_": F.col("bi"), "bj_": F.col("bj")})
    links = over_tiles(tiles, ["component"], ["node", "copies", "vec", "own", "bi_", "bj_"], lambda t: count({**t, "bi": t["bi_"], "bj": t["bj_"]}), "node long, links long")
    links = stored(links, "links").groupBy("node").agg(F.sum("links").alias("links"))
    known = nodes.drop("vec").join(parts, "node", "left").join(links, "node", "left").withColumn("component", F.coalesce("component", "node"))
    known = stored(known, "known")
    least = known.groupBy("component").agg(F.min("least").alias("component_id"))
    done = stored(known.join(least, "component").select("label", "dim", "h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "done")
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0))
    keyed = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(group).alias("label"), F.size(vector).alias("dim"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit("second"), v).alias("h2"))
    met = keyed.join(done, ["label", "dim", "h1", "h2"], "left")
    component = F.coalesce("component_id", "vec_id")
    return met.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
