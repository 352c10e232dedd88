"""Approximate nearest neighbours by randomly rotated one-bit codes (operator 12).

Vectors are scaled to length one.  Centres, fitted on a bounded sample, part
them into cells; what is left of a vector beyond its centre is rotated at random
into ``bits`` dimensions, of which the signs are kept: one bit each.  From the
packed bits and two correction scalars (the length of the rest, and the inner
product of its direction with that of its signs) the inner product with any query is
estimated without bias, within an error bound that holds but for the probability
that ``EPSILON`` stands for.  Vectors whose upper bound reaches a query's last
place so far are ranked again by their exact cosine.

A query first meets the blocks of its own cell; what it finds there says which
other cells it must meet: those whose radius leaves room for a nearer vector.
No number of cells or candidates is fixed, so nothing is left out but what the
bounds rule out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored
from .lexical_search import SALTS, best

KEEP, EVERY = 5, 50
"""Neighbours of a query; a vector is a query if its id is divisible by ``EVERY``."""
BITS = 256
"""Bits of a code, or as many as the vector has dimensions, if more."""
EPSILON = 3.0
"""Standard deviations of the estimate by which a bound is wide."""
SAMPLE = 20_000
"""Most vectors on which the centres are fitted."""
CELL, CELLS = 4_000, 1_024
"""Vectors, about, for which a centre is made, and most centres of one number of dimensions."""
ROUNDS = 6
"""Rounds of the fit of the centres."""
BLOCK = 8_388_608
"""Bytes, about, of the vectors of a cell that a task holds at once; larger cells have several blocks."""
QUERIES = 256
"""Queries that meet a block at once."""
SEED = 12


def scaled(vectors: np.ndarray) -> np.ndarray:
    """The vectors times a power of two each, which changes no cosine and lets no square overflow or vanish."""
    return np.ldexp(vectors, -np.frexp(np.abs(vectors).max(axis=1, keepdims=True))[1])


def unit(vectors: np.ndarray) -> np.ndarray:
    x = scaled(vectors)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(dim: int, bits: int) -> np.ndarray:
    """A random map into ``bits`` dimensions (or ``dim``, if more) that keeps all lengths and angles."""
    wide = max(bits, -(-dim // 8) * 8)
    q, r = np.linalg.qr(np.random.default_rng(SEED).standard_normal((wide, dim)))
    return q * np.sign(np.diag(r))


def coded(rest: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed bits, length, alignment) of each row of ``rest``."""
    length = np.sqrt((rest * rest).sum(axis=1))
    turned = rest @ turn.T / np.maximum(length, 1e-300)[:, None]
    aligned = np.abs(turned).sum(axis=1) / np.sqrt(turn.shape[0])
    return np.packbits(turned > 0, axis=1), length, np.where(length > 0, aligned, 1.0)


def signs(packed: np.ndarray) -> np.ndarray:
    """The directions that packed bits stand for."""
    wide = packed.shape[1] * 8
    return (np.unpackbits(packed, axis=1).astype(np.float32) * 2 - 1) / np.float32(np.sqrt(wide))


def estimates(directions: np.ndarray, length: np.ndarray, aligned: np.ndarray, turned: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(estimate, half width of its bound) of the inner products of rests, coded as given, with rotated queries: a row for each query."""
    wide = turned.shape[1]
    got = (turned.astype(np.float32) @ directions.T).astype(np.float64) * (length / aligned)
    spread = length * np.sqrt(np.maximum(0, 1 / aligned**2 - 1) / max(1, wide - 1))
    return got, EPSILON * np.sqrt((turned * turned).sum(axis=1))[:, None] * spread[None, :] + 1e-6


def nearest_centre(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return (x @ centres.T - (centres * centres).sum(axis=1) / 2).argmax(axis=1)


def fitted(sample: np.ndarray, many: int) -> np.ndarray:
    """``many`` centres of unit vectors, by rounds of means."""
    rng = np.random.default_rng(SEED)
    centres = sample[rng.choice(len(sample), min(many, len(sample)), replace=False)]
    for _ in range(ROUNDS):
        own = nearest_centre(sample, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        size = np.bincount(own, minlength=len(centres))
        centres[size > 0] = (sums / np.maximum(size, 1)[:, None])[size > 0]
    return np.unique(centres, axis=0)


def _stacked(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def distinct_vectors(rows: DataFrame, vector: str, keep: int) -> DataFrame:
    """(node, dim, ids, asked, vec): each different vector once, with its ``keep + 1`` smallest ids; ``asked`` if a query has it."""
    named = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(vector).cast("array<double>").alias("v")).where("vec_id is not null")
    fine = (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: F.coalesce(x, F.lit(0.0)) != 0)
    keyed = named.where(F.coalesce(fine, F.lit(False))).withColumn("v", F.transform("v", lambda x: x + F.lit(0.0)))
    keyed = keyed.withColumns({"h1": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), "v")})
    firsts = keyed.select("h1", "h2", "vec_id").distinct()
    salted = Window.partitionBy("h1", "h2", "salt").orderBy("vec_id")
    whole = Window.partitionBy("h1", "h2").orderBy("vec_id")
    thin = firsts.withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(SALTS))).withColumn("r", F.row_number().over(salted)).where(F.col("r") <= keep + 1)
    ids = thin.withColumn("r", F.row_number().over(whole)).where(F.col("r") <= keep + 1).groupBy("h1", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    once = keyed.groupBy("h1", "h2").agg(F.min("v").alias("v"), F.max(F.pmod("vec_id", F.lit(EVERY)) == 0).alias("asked"))
    met = once.join(ids, ["h1", "h2"]).select("h1", "h2", F.size("v").alias("dim"), "ids", "asked", "v")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vecs = [np.array(v, np.float64).tobytes() for v in batch["v"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch[c] for c in ("h1", "h2", "dim", "ids", "asked")), pa.array(vecs, pa.binary())], names=["h1", "h2", "dim", "ids", "asked", "vec"])

    return stored(met.mapInArrow(pack, "h1 long, h2 long, dim int, ids array<long>, asked boolean, vec binary").withColumn("node", F.monotonically_increasing_id()), "vectors")


class _Cells:
    """Centres by number of dimensions; cell numbers run over all of them."""

    def __init__(self, nodes: DataFrame):
        sizes = {r.dim: r.n for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "dim").limit(1_000).collect()}
        sample: dict[int, list] = {}
        for r in nodes.select("dim", "vec").orderBy(F.xxhash64("h1", "h2"), "h1").limit(SAMPLE).collect():
            sample.setdefault(r.dim, []).append(np.frombuffer(r.vec, np.float64))
        self.centres: dict[int, np.ndarray] = {}
        self.first: dict[int, int] = {}
        at = 1  # vectors whose number of dimensions the sample doesn't hold have cell 0
        for dim, vecs in sorted(sample.items()):
            self.centres[dim] = fitted(unit(np.array(vecs)), max(1, min(CELLS, -(-sizes.get(dim, 1) // CELL))))
            self.first[dim] = at
            at += len(self.centres[dim])

    def of(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """(nearest centre of each unit vector, all centres, number of the first)."""
        dim = x.shape[1]
        centres = self.centres.get(dim)
        if centres is None:
            centres = np.zeros((1, dim))
        return nearest_centre(x, centres), centres, self.first.get(dim, 0)


def _by_dim(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    dims = batch["dim"].to_numpy()
    for dim in np.unique(dims).tolist():
        part = batch.filter(pa.array(dims == dim))
        yield part, _stacked(part["vec"])


def indexed(nodes: DataFrame, cells: _Cells, bits: int = BITS) -> DataFrame:
    """(dim, cell, node, first_id, asked, code, length, aligned, toward, vec): the index, a row for each different vector; ``toward`` is the inner product of a rest with its centre."""
    held = nodes.sparkSession.sparkContext.broadcast(cells)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, vec in _by_dim(batch):
                x = unit(vec)
                own, centres, first = held.value.of(x)
                turn = turns.setdefault(x.shape[1], rotation(x.shape[1], bits))
                code, length, aligned = coded(x - centres[own], turn)
                toward = np.einsum("ij,ij->i", x - centres[own], centres[own])
                made = [pa.array((own + first).astype(np.int32)), pa.array([c.tobytes() for c in code], pa.binary()), *map(pa.array, (length, aligned, toward))]
                yield pa.RecordBatch.from_arrays([*(part[c] for c in kept), *made], names=[*kept, "cell", "code", "length", "aligned", "toward"])

    kept = ["dim", "node", "first_id", "asked", "vec"]
    rows = nodes.select("dim", "node", F.element_at("ids", 1).alias("first_id"), "asked", "vec")
    return stored(rows.mapInArrow(encode, "dim int, node long, first_id long, asked boolean, vec binary, cell int, code binary, length double, aligned double, toward double"), "codes")


def _met(index: DataFrame, visits: DataFrame, sizes: DataFrame, cells: _Cells, bits: int, keep: int) -> DataFrame:
    """(query, node, first_id, score): for each visit (dim, cell, query, vec, least) of a query to a cell, the ``keep`` nearest of every block with a cosine of ``least`` or more."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    rows = index.join(sizes, ["dim", "cell"]).select("dim", "cell", block.alias("block"), F.lit(0).alias("kind"), "node", "first_id", "code", "length", "aligned", "toward", "vec", F.lit(0.0).alias("least"))
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    nothing = [F.lit(None).cast(kind).alias(c) for c, kind in (("first_id", "long"), ("code", "binary"), ("length", "double"), ("aligned", "double"), ("toward", "double"))]
    asked = visits.join(sizes, ["dim", "cell"]).select("dim", "cell", blocks.alias("block"), F.lit(1).alias("kind"), F.col("query").alias("node"), *nothing, "vec", "least")
    keys = ["dim", "cell", "block"]
    dealt = rows.unionByName(asked).repartition(*keys).sortWithinPartitions(*keys, "kind", "node")
    held = index.sparkSession.sparkContext.broadcast(cells)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns: dict[int, np.ndarray] = {}
        at: tuple | None = None
        gathered: list[pa.RecordBatch] = []
        known: dict = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            of = [batch[c].to_numpy() for c in (*keys, "kind")]
            cuts = np.flatnonzero(np.any([c[1:] != c[:-1] for c in of], axis=0)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                now = tuple(int(c[lo]) for c in of)
                part = batch.slice(lo, hi - lo)
                if now[:3] != at:
                    at, gathered, known = now[:3], [], {}
                if now[3] == 0:
                    gathered.append(part)
                    continue
                if gathered:
                    t = pa.Table.from_batches(gathered).combine_chunks()
                    packed = np.frombuffer(b"".join(t["code"].to_pylist()), np.uint8).reshape(t.num_rows, -1)
                    known = {c: t[c].to_numpy() for c in ("node", "first_id", "length", "aligned", "toward")} | {"directions": signs(packed), "x": scaled(_stacked(t["vec"]))}
                    known["norm"] = np.sqrt((known["x"] ** 2).sum(axis=1))
                    gathered = []
                if not known:
                    continue
                dim = now[0]
                turn = turns.setdefault(dim, rotation(dim, bits))
                _, centres, first = held.value.of(np.zeros((0, dim)))
                for from_ in range(0, part.num_rows, QUERIES):
                    some = part.slice(from_, QUERIES)
                    found = _nearest(known, centres[now[1] - first], turn, scaled(_stacked(some["vec"])), some["least"].to_numpy(), keep)
                    query = some["node"].to_numpy()[found[0]]
                    yield pa.RecordBatch.from_arrays([pa.array(query), *(pa.array(known[c][found[1]]) for c in ("node", "first_id")), pa.array(found[2])], names=["query", "node", "first_id", "score"])

    return dealt.mapInArrow(search, "query long, node long, first_id long, score double")


def _nearest(known: dict, centre: np.ndarray, turn: np.ndarray, vecs: np.ndarray, least: np.ndarray, keep: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, cosine): the ``keep`` nearest rows of a block for each query, among equal ones those of the smallest first id."""
    norm = np.sqrt((vecs * vecs).sum(axis=1))
    x = vecs / norm[:, None]
    rest, width = estimates(known["directions"], known["length"], known["aligned"], (x - centre) @ turn.T)
    low = rest + (x @ centre)[:, None] + known["toward"]
    high = low + width
    low -= width
    if low.shape[1] > keep:
        least = np.maximum(least, np.partition(low, -keep, axis=1)[:, -keep])
    out = []
    for q in range(len(x)):
        rows = np.flatnonzero(high[q] >= least[q] - 1e-9)
        cosine = known["x"][rows] @ vecs[q] / (known["norm"][rows] * norm[q])
        if len(rows) > keep:
            first = np.lexsort((known["first_id"][rows], -cosine))[:keep]
            rows, cosine = rows[first], cosine[first]
        out.append((np.full(len(rows), q), rows, cosine))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True))  # type: ignore[return-value]


def _places(found: DataFrame, keep: int) -> DataFrame:
    """The ``keep`` best (query, node, score) of each query, which no hot query hinders."""
    return best(found, "query", [F.desc("score"), "first_id"], keep, "place").drop("place")


def neighbours(rows: DataFrame, vector: str = "embedding", keep: int = KEEP, bits: int = BITS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``keep`` vectors of the largest cosine found for each query, itself apart.

    Queries are the rows whose vec_id is divisible by ``EVERY``; every other
    row is a candidate.  Vectors that are null, empty, zero or hold a null or
    non-finite component, and rows without a vec_id, take no part.  Vectors of
    different numbers of dimensions are not compared.  Equal vectors are
    searched once, and each of their ids counts; repeated rows count once, and
    a vec_id that several vectors share is found by its best.  Ties go to the
    smaller vec_id.  With fewer candidates all are given, with none no row;
    extra columns are ignored.
    """
    nodes = distinct_vectors(rows, vector, keep)
    cells = _Cells(nodes)
    index = indexed(nodes, cells, bits)
    # A cell's radius; its number of blocks follows its size.
    sizes = stored(index.groupBy("dim", "cell").agg(F.ceil(F.count("*") * F.col("dim") * 8 / BLOCK).cast("int").alias("blocks"), F.max("length").alias("radius")), "cells")
    asked = index.where("asked").select("node", "dim", "vec")
    own = index.where("asked").select("dim", "cell", F.col("node").alias("query"), "vec", F.lit(-2.0).alias("least"))
    # ``keep + 1`` places, as one may be the query itself.
    near = stored(_met(index, own, sizes.select("dim", "cell", "blocks"), cells, bits, keep + 1), "near")
    place = _places(near, keep + 1).groupBy("query").agg(F.count("*").alias("n"), F.min("score").alias("last"))
    least = place.select(F.col("query").alias("node"), F.when(F.col("n") > keep, F.col("last")).otherwise(-2.0).alias("least"))
    radii = {(r.dim, r.cell): r.radius for r in sizes.collect()}  # a row for each centre
    held = nodes.sparkSession.sparkContext.broadcast((cells, radii))

    def onward(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, radii = held.value
        for batch in batches:
            for part, vec in _by_dim(batch):
                x = unit(vec)
                mine, centres, first = cells.of(x)
                radius = np.array([radii.get((x.shape[1], first + c), -np.inf) for c in range(len(centres))])  # no vector, no visit
                far = np.sqrt(np.maximum(0, 1 - 2 * (x @ centres.T) + (centres * centres).sum(axis=1)))
                # The largest cosine that the cell's nearest point allows.
                reach = (1 - np.maximum(0, far - radius) ** 2 / 2 >= part["least"].to_numpy()[:, None] - 1e-9) & (radius >= 0)
                reach[np.arange(len(x)), mine] = False
                query, cell = np.nonzero(reach)
                for at in range(0, len(query), 10_000):
                    q, c = query[at : at + 10_000], cell[at : at + 10_000]
                    some = part.take(pa.array(q))
                    yield pa.RecordBatch.from_arrays([some["dim"], pa.array((c + first).astype(np.int32)), some["node"], some["vec"], some["least"]], names=["dim", "cell", "query", "vec", "least"])

    visits = asked.join(least, "node").mapInArrow(onward, "dim int, cell int, query long, vec binary, least double")
    more = _met(index, visits, sizes.select("dim", "cell", "blocks"), cells, bits, keep + 1)
    found = stored(_places(near.unionByName(more), keep + 1), "found")
    ids = nodes.select("node", F.explode("ids").alias("vec_id"))
    listed = found.join(ids, "node").groupBy("query").agg(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "vec_id"))).alias("list"))  # keep + 1 nodes of as many ids at most
    answers = stored(listed.join(nodes.select(F.col("node").alias("query"), "h1", "h2"), "query").select("h1", "h2", "list"), "answers")
    v = F.transform(F.col(vector).cast("array<double>"), lambda x: x + F.lit(0.0))
    queries = rows.where(F.pmod(F.col("vec_id").cast("long"), F.lit(EVERY)) == 0).select(F.col("vec_id").cast("long").alias("query_id"), F.xxhash64(v).alias("h1"), F.xxhash64(F.lit("second"), v).alias("h2")).distinct()
    each = queries.join(answers, ["h1", "h2"]).select("query_id", F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, 2 * keep).alias("list"))
    pairs = each.select("query_id", F.explode("list").alias("x")).groupBy("query_id", "x.vec_id").agg(F.max(-F.col("x.s")).alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep).select("query_id", "rank", "vec_id", "score")
