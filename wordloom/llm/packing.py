"""Packing documents into sequences by non-negative least squares (operator 8).

Each document is cut into full windows, one main piece of a whole number of
units, and a tail shorter than a unit.  Main pieces are packed by their length
in units: all combinations of up to ``DEPTH`` lengths that fill a window are
enumerated, non-negative least squares gives how often to repeat each against
the histogram of lengths, the counts are rounded, and what is left over is
packed greedily.  Tails follow one another in windows of their own.  Only the
histogram, of at most ``WINDOW / UNIT`` rows, is gathered on the driver; which
document takes which place follows from its rank among those of its length.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_batches, stored
from .token_cache import piece_tokenizer

WINDOW, UNIT, DEPTH = 2048, 16, 3


def combinations(units: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Every falling tuple of up to ``depth`` lengths of 1 to units-1 that adds up to ``units``."""

    def grow(rest: int, most: int, deep: int) -> Iterator[tuple[int, ...]]:
        if rest == 0:
            yield ()
        elif deep:
            for x in range(min(rest, most), 0, -1):
                if x * deep < rest:
                    break
                for tail in grow(rest - x, x, deep - 1):
                    yield (x, *tail)

    return list(grow(units, units - 1, depth))


def nonnegative_least_squares(a: np.ndarray, b: np.ndarray, steps: int | None = None) -> np.ndarray:
    """x >= 0 that makes |a x - b| least, by the active-set method."""
    n = a.shape[1]
    x, free = np.zeros(n), np.zeros(n, bool)
    gain = a.T @ b
    eps = 1e-9 * max(1.0, float(np.abs(gain).max(initial=0)))
    for _ in range(steps or 6 * a.shape[0]):
        gain = a.T @ (b - a @ x)
        gain[free] = -np.inf
        j = int(np.argmax(gain)) if n else 0
        if not n or gain[j] <= eps:
            break
        free[j] = True
        while True:
            z = np.zeros(n)
            z[free] = np.linalg.lstsq(a[:, free], b, rcond=None)[0]
            bad = free & (z <= 1e-12)
            if not bad.any():
                x = z
                break
            ratio = x[bad] / np.maximum(x[bad] - z[bad], 1e-300)
            x = x + float(ratio.min()) * (z - x)
            free &= x > 1e-12
            x[~free] = 0
    return x


def plan(histogram: dict[int, int], units: int = WINDOW // UNIT) -> list[tuple[int, tuple[int, ...]]]:
    """(repeats, lengths) that hold every length of ``histogram`` (length in units -> pieces) once."""
    left = np.zeros(units, np.int64)
    for k, n in histogram.items():
        left[k] = n
    combos = combinations(units)
    a = np.zeros((units, len(combos)))
    for j, combo in enumerate(combos):
        for k in combo:
            a[k, j] += 1
    scale = max(1.0, float(left.max()))
    wanted = nonnegative_least_squares(a[1:], left[1:] / scale) * scale
    out: list[tuple[int, tuple[int, ...]]] = []
    for j in np.argsort(-wanted, kind="stable"):
        if wanted[j] <= 0:
            break
        need = a[:, j].astype(np.int64)
        repeats = min(int(np.floor(wanted[j] + 0.5)), int((left[need > 0] // need[need > 0]).min()))
        if repeats:
            out.append((repeats, combos[j]))
            left -= repeats * need
    while left.any():  # the longest first, then as many of the longest that fit as there are
        room, held = units, np.zeros(units, np.int64)
        for k in range(units - 1, 0, -1):
            held[k] = min(int(left[k]), room // k)
            room -= int(held[k]) * k
        used = held > 0
        repeats = int((left[used] // held[used]).min())
        out.append((repeats, tuple(k for k in range(units - 1, 0, -1) for _ in range(held[k]))))
        left -= repeats * held
    return out


CUT = "doc_id long, doc_tokens long, full_crc array<long>, units int, main_crc long, tail binary, pid int, unit_rank long, full_before long, tail_before long"


def cut_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """A row for each document: its windows' digests, main piece and tail, and counts within its partition."""

    def make():
        tokenizer = piece_tokenizer(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        ranks, before = [0] * (WINDOW // UNIT), {"full": 0, "tail": 0}

        def step(batch: dict | None) -> Iterator[dict]:
            if not batch:
                return
            pid = TaskContext.get().partitionId()
            out: dict[str, list] = {k.split(" ")[0]: [] for k in CUT.split(", ")}
            out["doc_id"] = batch["doc_id"]
            for encoded in tokenizer.ids(batch["text"], 5_000_000):
                ids = encoded + end
                n = len(ids) // 4
                full, rest = divmod(n, WINDOW)
                units, tail = divmod(rest, UNIT)
                main_to = 4 * (n - tail)
                out["doc_tokens"].append(n)
                out["full_crc"].append([zlib.crc32(ids[4 * WINDOW * k : 4 * WINDOW * (k + 1)]) for k in range(full)])
                out["units"].append(units)
                out["main_crc"].append(zlib.crc32(ids[4 * WINDOW * full : main_to]))
                out["tail"].append(ids[main_to:])
                out["pid"].append(pid)
                out["unit_rank"].append(ranks[units])
                out["full_before"].append(before["full"])
                out["tail_before"].append(before["tail"])
                ranks[units] += 1
                before["full"] += full
                before["tail"] += tail
            yield out

        return step

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), make, CUT, "pieces")


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def packed_pieces(docs: DataFrame, tokenizer_path: str, end_id: int = 1) -> DataFrame:
    """A row for each piece of each document: where it lies in the document and in which sequence.

    Null texts count as empty: their end id alone is packed.  Repeated rows and
    null ids are documents of their own; extra columns play no part; an empty
    table gives no rows.  Sequences are numbered from 0: full windows, planned
    windows, windows of tails.
    """
    cut = stored(cut_documents(docs, tokenizer_path, end_id), "cut")
    by_unit = cut.groupBy("pid", "units").agg(F.count("*").alias("n"))
    unit_base = by_unit.withColumn("rank_base", F.sum("n").over(Window.partitionBy("units").orderBy("pid")) - F.col("n")).drop("n")
    by_pid = cut.groupBy("pid").agg(F.sum(F.size("full_crc")).alias("full"), F.sum(F.length("tail") / 4).cast("long").alias("tails"))
    order = Window.orderBy("pid")  # one row a partition of the input
    pid_base = by_pid.select("pid", (F.sum("full").over(order) - F.col("full")).alias("full_base"), (F.sum("tails").over(order) - F.col("tails")).alias("tail_base"))
    n_full = int(by_pid.agg(F.coalesce(F.sum("full"), F.lit(0))).first()[0])
    histogram = {r["units"]: r["n"] for r in by_unit.where("units > 0").groupBy("units").agg(F.sum("n").alias("n")).collect()}
    # For each length: from which rank on the next combination takes it, and where its pieces go.
    slots: dict[int, list[tuple[int, int, int, int]]] = {k: [] for k in histogram}
    taken, sequence = dict.fromkeys(histogram, 0), n_full
    for repeats, combo in plan(histogram) if histogram else []:
        offset = 0
        for k in sorted(set(combo), reverse=True):
            many = combo.count(k)
            slots[k].append((taken[k], many, sequence, offset))
            taken[k] += many * repeats
            offset += many * k
        sequence += repeats
    first_tail = sequence
    tables = {k: np.array(v, np.int64) for k, v in slots.items()}

    def make():
        def step(batch: dict | None) -> Iterator[dict]:
            if not batch:
                return
            rows = []
            for doc, n, crcs, units, main_crc, tail, rank, full, at in zip(*(batch[k] for k in ("doc_id", "doc_tokens", "full_crc", "units", "main_crc", "tail", "rank", "full_at", "tail_at")), strict=True):
                for i, crc in enumerate(crcs):
                    rows.append((doc, i * WINDOW, WINDOW, crc, n, full + i, 0))
                if units:
                    own = tables[units]
                    base, many, seq, offset = own[np.searchsorted(own[:, 0], rank, "right") - 1].tolist()
                    turn, slot = divmod(rank - base, many)
                    rows.append((doc, len(crcs) * WINDOW, units * UNIT, main_crc, n, seq + turn, (offset + slot * units) * UNIT))
                done, size = 0, len(tail) // 4
                while done < size:
                    seq, offset = divmod(at + done, WINDOW)
                    length = min(size - done, WINDOW - offset)
                    rows.append((doc, n - size + done, length, zlib.crc32(tail[4 * done : 4 * (done + length)]), n, first_tail + seq, offset))
                    done += length
            names = [c.split(" ")[0] for c in PIECE.split(", ")]
            if rows:
                yield dict(zip(names, map(list, zip(*rows, strict=True)), strict=True))

        return step

    placed = cut.join(unit_base, ["pid", "units"]).join(pid_base, "pid").select("doc_id", "doc_tokens", "full_crc", "units", "main_crc", "tail", (F.col("unit_rank") + F.col("rank_base")).alias("rank"), (F.col("full_before") + F.col("full_base")).alias("full_at"), (F.col("tail_before") + F.col("tail_base")).alias("tail_at"))
    return map_batches(placed, make, PIECE)
