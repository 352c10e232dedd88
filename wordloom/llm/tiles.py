"""All links within groups of any size, a bounded block of rows at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import stored

BLOCK_ROWS = 512
"""A group of more rows than this is cut into blocks of about as many, and each pair of blocks is a tile."""


def tiled(rows: DataFrame, group: list[str], item: str) -> DataFrame:
    """The rows of groups of two or more, with the tile (bi, bj) of blocks that each copy is for.

    A row of a group of one block gets the tile (0, 0).  In a larger group
    every row goes to the tiles of its own block with each other block, so each
    pair of rows meets in some tile, at a cost of one copy a block.  ``own`` is
    the row's block.
    """
    sizes = stored(rows.groupBy(*group).agg(F.count("*").alias("n_rows")).where("n_rows > 1").withColumn("blocks", F.ceil(F.col("n_rows") / BLOCK_ROWS).cast("int")).drop("n_rows"), "sizes")
    own = F.pmod(F.xxhash64(item), F.col("blocks")).cast("int")
    met = rows.join(sizes, group).withColumn("own", own)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    return met.withColumn("other", other).withColumn("bi", F.least("own", "other")).withColumn("bj", F.greatest("own", "other")).drop("other", "blocks")


def over_tiles(tiles: DataFrame, group: list[str], columns: list[str], each: Callable[[dict[str, np.ndarray]], dict | None], schema: str) -> DataFrame:
    """Apply ``each`` to the rows of every tile, given as arrays by name; it returns columns or None."""
    keys = [*group, "bi", "bj"]
    dealt = tiles.select(*keys, *columns).repartition(*keys).sortWithinPartitions(*keys)
    parsed = StructType.fromDDL(schema)
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(parsed)
    flush = 20_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        out: dict[str, list] = {f.name: [] for f in arrow}
        count = 0

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[f.name]) if out[f.name] else [], type=f.type) for f in arrow], schema=arrow)

        def work(t: pa.Table, ends: np.ndarray) -> None:
            nonlocal count
            arrays = {c: t[c].to_numpy() if not pa.types.is_nested(t[c].type) else t[c].combine_chunks() for c in columns}
            for lo, hi in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                if hi - lo > 1:
                    part = each({c: a[lo:hi] for c, a in arrays.items()})
                    if part:
                        for k, v in part.items():
                            out[k].append(np.asarray(v))
                        count += len(next(iter(part.values())))

        def cut(t: pa.Table) -> np.ndarray:
            new = np.zeros(t.num_rows, bool)
            new[:1] = True
            for k in keys:
                v = t[k].to_numpy()
                new[1:] |= v[1:] != v[:-1]
            return np.append(np.flatnonzero(new), t.num_rows)

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            t = pa.Table.from_batches(held)
            ends = cut(t)
            if len(ends) > 2:  # the last tile may go on in the next batch
                last = int(ends[-2])
                work(t.slice(0, last), ends[:-1])
                held = t.slice(last).combine_chunks().to_batches()
            if count >= flush:
                yield made()
                out, count = {f.name: [] for f in arrow}, 0
        if held:
            t = pa.Table.from_batches(held)
            work(t, cut(t))
        if count:
            yield made()

    return dealt.mapInArrow(run, parsed)


def least_labels(linked: np.ndarray) -> np.ndarray:
    """For a symmetric matrix of links: the smallest index that each row reaches."""
    n = len(linked)
    label = np.arange(n)
    np.fill_diagonal(linked, True)
    while True:
        new = np.where(linked, label[None, :], n).min(axis=1)
        new = new[new]
        if (new == label).all():
            return label
        label = new
