"""Token-id files in Simple-8b words (operator 4).

A 64-bit word holds a 4-bit selector and, in its low 60 bits, as many ids as the
selector says, all of one width, the first id lowest.  Selector 0 is an escape:
the word holds the place of one id of over 60 bits in the exceptions beside the
words.  Blocks of ``BLOCK`` ids start at word offsets that are stored too, so
that all blocks are packed and read side by side.

A file row holds whole documents: their ids (``doc_ids``, ``doc_tokens``), the
words, the blocks' offsets and the exceptions.  Rows are numbered within a
shard, shards in the order of doc_id.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, shared_dir, stored
from .token_cache import piece_tokenizer

BLOCK = 1024
"""Ids of a block."""

# Fixed values of the coding: ids in a word, and bits of an id, for the selectors 2 to 15.
COUNTS = (60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1)
WIDTHS = (1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60)

_COUNT_OF = np.array([1, 0, *COUNTS], np.int64)
_LIMITS = np.array([(1 << w) - 1 for w in WIDTHS], np.uint64)
_SHORT_CLASS = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64)).astype(np.uint8)
_MOST = max(COUNTS)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, word offset of each block, exceptions) of the unsigned ids."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    blocks = -(-n // BLOCK)
    kind = np.uint16 if int(ids.max()) < 1 << 16 else np.uint64
    grid = np.zeros((blocks, BLOCK + _MOST), kind)
    full = n // BLOCK
    grid[:full, :BLOCK] = ids[: full * BLOCK].reshape(full, BLOCK)
    grid[full:, : n - full * BLOCK] = ids[full * BLOCK :]
    need = _SHORT_CLASS[grid] if kind is np.uint16 else np.searchsorted(_LIMITS, grid.ravel()).astype(np.uint8).reshape(grid.shape)
    # The widest need among the next c ids, for growing c; the largest c whose width suffices wins.
    best = np.zeros((blocks, BLOCK), np.uint8)
    widest = need[:, :BLOCK].copy()
    size = 1
    for k in range(len(COUNTS) - 1, -1, -1):
        for more in range(size, COUNTS[k]):
            np.maximum(widest, need[:, more : more + BLOCK], out=widest)
        size = COUNTS[k]
        fits = widest <= k
        if not fits.any():
            break
        np.copyto(best, k + 2, where=fits)
    # All blocks step through their ids at once.
    step_of = _COUNT_OF[best].astype(np.uint8).ravel()
    live = np.arange(blocks, dtype=np.int64)
    at, end, steps = live * BLOCK, np.minimum((live + 1) * BLOCK, n), []
    while len(live):
        steps.append((live, at - live * BLOCK))
        at = at + step_of.take(at)
        on = at < end
        if not on.all():
            live, at, end = live[on], at[on], end[on]
    of = np.concatenate([b for b, _ in steps])
    start = np.concatenate([p for _, p in steps])
    order = np.argsort(of, kind="stable")
    of, start = of[order], start[order]
    selector = best[of, start]
    words = selector.astype(np.uint64) << np.uint64(60)
    place = of * grid.shape[1] + start
    values = grid.ravel()
    for k, (count, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        mine = np.flatnonzero(selector == k + 2)
        if len(mine):
            at, word = place[mine], words[mine]
            for i in range(count):
                word |= values.take(at + i).astype(np.uint64) << np.uint64(i * width)
            words[mine] = word
    escaped = np.flatnonzero(selector == 0)
    words[escaped] = np.arange(len(escaped), dtype=np.uint64)
    offsets = np.searchsorted(of, np.arange(blocks)).astype(np.uint32)
    return words, offsets, values[place[escaped]].astype(np.uint64)


def unpack(words: np.ndarray, offsets: np.ndarray, exceptions: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` ids that ``pack`` was given."""
    if not n:
        return np.zeros(0, np.uint64)
    blocks = len(offsets)
    selector = (words >> np.uint64(60)).astype(np.uint8)
    count = _COUNT_OF[selector]
    ends = np.cumsum(count)
    first = np.concatenate([[0], ends])[offsets.astype(np.int64)]
    of = np.repeat(np.arange(blocks), np.diff(np.append(offsets.astype(np.int64), len(words))))
    grid = np.zeros((blocks, BLOCK + _MOST), np.uint64)
    out = grid.ravel()
    place = of * grid.shape[1] + (ends - count) - first[of]
    for k, (many, width) in enumerate(zip(COUNTS, WIDTHS, strict=True)):
        mine = np.flatnonzero(selector == k + 2)
        if len(mine):
            own, to, mask = words[mine], place[mine], np.uint64((1 << width) - 1)
            for i in range(many):
                out[to + i] = own >> np.uint64(i * width) & mask
    escaped = np.flatnonzero(selector == 0)
    out[place[escaped]] = exceptions[words[escaped].astype(np.int64)]
    return grid[:, :BLOCK].ravel()[:n]


FILE = "shard int, part long, n_ids long, doc_ids array<long>, doc_tokens array<long>, offsets binary, words binary, exceptions binary"


def encoded_rows(docs: DataFrame, tokenizer_path: str, end_id: int = 0, row_ids: int = 1 << 20) -> DataFrame:
    """File rows of the documents' ids in ascending doc_id order, each document ended by ``end_id``.

    Null texts count as empty, null doc_ids come first, and rows of one doc_id
    follow each other in an order that their texts fix.  A row takes documents
    until it holds ``row_ids`` ids.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def make():
        tokenizer = piece_tokenizer(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        held: dict[str, list] = {"doc": [], "ids": []}
        state = {"part": 0, "bytes": 0}

        def flush() -> dict:
            ids = np.frombuffer(b"".join(held["ids"]), "<u4")
            words, offsets, exceptions = pack(ids)
            row = {
                "shard": [TaskContext.get().partitionId()], "part": [state["part"]], "n_ids": [len(ids)], "doc_ids": [held["doc"]], "doc_tokens": [[len(x) // 4 for x in held["ids"]]],
                "offsets": [offsets.astype("<u4").tobytes()], "words": [words.astype("<u8").tobytes()], "exceptions": [exceptions.astype("<u8").tobytes()],
            }
            held["doc"], held["ids"] = [], []
            state["part"] += 1
            state["bytes"] = 0
            return row

        def step(batch: dict | None) -> Iterator[dict]:
            if batch is None:
                if held["doc"]:
                    yield flush()
                return
            for doc, ids in zip(batch["doc_id"], tokenizer.ids(batch["text"]), strict=True):
                held["doc"].append(doc)
                held["ids"].append(ids + end)
                state["bytes"] += len(ids) + 4
                if state["bytes"] >= 4 * row_ids:
                    yield flush()

        return step

    return map_batches(ordered.select("doc_id", "text"), make, FILE, "pieces")


def write_ids(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 0) -> None:
    """Write the documents' ids to ``path``; see the module for the format."""
    encoded_rows(docs, tokenizer_path, end_id).write.parquet(path)


def read_ids(files: DataFrame) -> DataFrame:
    """Decode file rows: (doc_id, start, n_tokens, ids), start counted over all shards."""
    return _placed(files, True)


def read_digests(files: DataFrame) -> DataFrame:
    """Decode file rows: (doc_id, start, n_tokens, ids_crc32)."""
    return _placed(files, False)


def _placed(files: DataFrame, whole: bool) -> DataFrame:
    def make():
        def step(batch: dict | None) -> Iterator[dict]:
            if not batch:
                return
            for shard, part, n, docs, sizes, offsets, words, exceptions in zip(*(batch[k] for k in ("shard", "part", "n_ids", "doc_ids", "doc_tokens", "offsets", "words", "exceptions")), strict=True):
                ids = unpack(np.frombuffer(words, "<u8"), np.frombuffer(offsets, "<u4"), np.frombuffer(exceptions, "<u8"), n)
                ends = np.cumsum(sizes)
                out = {"shard": [shard] * len(docs), "part": [part] * len(docs), "doc_id": docs, "within": ends - sizes, "n_tokens": sizes}
                if whole:
                    out["ids"] = [ids[e - k : e].astype(np.int64) for e, k in zip(ends, sizes, strict=True)]
                else:
                    view = memoryview(ids.astype("<u4")).cast("B")
                    out["ids_crc32"] = [zlib.crc32(view[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), sizes, strict=True)]
                yield out

        return step

    last = "ids array<long>" if whole else "ids_crc32 long"
    decoded = map_batches(files.select("shard", "part", "n_ids", "doc_ids", "doc_tokens", "offsets", "words", "exceptions"), make, f"shard int, part long, doc_id long, within long, n_tokens long, {last}")
    # Rows before in the shard, then shards before: sums over one row a shard.
    parts = files.select("shard", "part", "n_ids").withColumn("before", F.sum("n_ids").over(Window.partitionBy("shard").orderBy("part")) - F.col("n_ids"))
    shards = files.groupBy("shard").agg(F.sum("n_ids").alias("all")).withColumn("shard_before", F.sum("all").over(Window.orderBy("shard")) - F.col("all"))
    base = parts.join(shards, "shard").select("shard", "part", (F.col("before") + F.col("shard_before")).alias("base"))
    return decoded.join(base, ["shard", "part"]).select("doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", last.split(" ")[0])


def written_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 0) -> DataFrame:
    """Write the ids to the shared folder, read the files back, and describe each document.

    An empty table gives no rows; extra columns play no part.
    """
    return read_digests(stored(encoded_rows(docs, tokenizer_path, end_id), "ids"))


__all__ = ["encoded_rows", "pack", "read_digests", "read_ids", "shared_dir", "unpack", "write_ids", "written_and_read"]
