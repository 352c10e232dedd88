"""Repeated byte strings of a given length by suffix arrays (operator 9).

A shard must hold all places of a string, so places are dealt out by content.
Every window of that length has one minimizer: the place in it, leftmost of equals,
whose 16 bytes have the least hash.  Windows with one minimizer, as far as they
lie at like distances before it (a cell of distances), form a segment; all of
them contain the same core around the minimizer, so equal windows lie in
segments of one key, the hash of the core.  Every window lies in one segment.

Segments of equal content are one from then on, with a count.  Keys under which
contents differ go to shards; each shard's segments are joined, their suffix
array is induced, and permuted common prefixes of that length or more mark the
starts of repeated strings.  A key with more than ``SHARD`` bytes is split into
cells of shorter distances, whose cores are longer, until the cell is a single
window.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import map_batches, passing, stored
from .suffix_array import common_prefixes, suffix_array

MATCH, GRAM = 400, 16
"""Bytes of a string that must repeat, where nothing else is asked for; and those that a minimizer is chosen by."""
SHARD = 1 << 20
"""Bytes of a shard, about; keys with more are split."""
FEW = 2_000_000
"""Most keys found twice, of 8 bytes each, that are broadcast; more are joined by a shuffle."""
BLOCK = 1 << 22
"""Windows of a text that are searched at once."""
TOGETHER = 1 << 15
"""Bytes of short texts that are searched at once: arrays of so many places stay in the cache."""

_NO_ID = -(1 << 63)


@functools.cache
def cells(match: int) -> list[int]:
    """Distances in a cell, at each level of splitting; each divides the one before.

    The first is at most half of the distances, so that a core holds half a string or more.
    """
    most = (match - GRAM) // 2
    if most < 1:
        raise ValueError(f"strings must have more than {GRAM + 1} bytes")
    out = [most]
    while out[-1] > 1:
        out.append(next((out[-1] // p for p in (2, 3, 5, 7) if out[-1] % p == 0), 1))
    return out


def minimizer_runs(data: np.ndarray, match: int = MATCH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first start, last start) of each run of windows that share their minimizer."""
    parts = [_runs(data, at, min(at + BLOCK, len(data) - match + 1), match) for at in range(0, len(data) - match + 1, BLOCK)]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, np.int64),) * 3


def _runs(data: np.ndarray, first: int, end: int, match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    place = _minimizers(data[first : end + match - 1], match)
    new = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    return place[new] + first, new + first, np.append(new[1:], len(place)) - 1 + first


def _minimizers(data: np.ndarray, match: int) -> np.ndarray:
    """The place of the minimizer of each window."""
    part = data.astype(np.uint64) + np.uint64(1)
    h, size, factor = part, 1, np.uint64(0x9E3779B97F4A7C15)
    while size < GRAM:
        h = h[:-size] * factor + h[size:]
        factor = np.uint64(int(factor) ** 2 % (1 << 64))
        size *= 2
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h = (h & ~np.uint64((1 << 24) - 1)) | np.arange(len(h), dtype=np.uint64)
    width, best, size = match - GRAM + 1, h, 1
    while 2 * size <= width:
        best = np.minimum(best[:-size], best[size:])
        size *= 2
    if size < width:
        best = np.minimum(best[: len(best) - (width - size)], best[width - size :])
    return (best & np.uint64((1 << 24) - 1)).astype(np.int64)


def runs_of(texts: list[bytes], match: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(text, minimizer, first start, last start) of the runs of several texts that are joined without marks; no window spans two."""
    size = np.array([len(t) for t in texts])
    end = np.cumsum(size)
    windows = np.maximum(size - match + 1, 0)
    place = _minimizers(np.frombuffer(b"".join(texts), np.uint8), match)
    owner = np.repeat(np.arange(len(texts)), windows)
    start = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows) + (end - size)[owner]
    place = place[start]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (owner[1:] != owner[:-1])])) if len(owner) else np.zeros(0, np.int64)
    return owner[new], place[new], start[new], start[np.append(new[1:], len(owner)) - 1] if len(new) else new


def segments(text: bytes, place: int, first: int, last: int, level: int, base: int = 0, match: int = MATCH) -> Iterator[tuple[int, bytes, int, int]]:
    """(key, content's digest, first start, windows) for each cell of a run; ``base`` is taken off the places to find bytes."""
    cell = cells(match)[level]
    for c in range((place - last) // cell, (place - first) // cell + 1):
        a, b = max(first, place - c * cell - cell + 1), min(last, place - c * cell)
        core = text[place - c * cell - base : place - c * cell - cell + 1 + match - base]
        key = xxh3_64_intdigest(core, 1000 * level + c)
        yield key - (1 << 64) if key >> 63 else key, xxh3_128_digest(text[a - base : b + match - base]), a, b - a + 1


def all_segments(texts: list[bytes], match: int = MATCH) -> tuple[list[int], list[int], list[bytes], list[int], list[int], list[int]]:
    """(texts, keys, contents, starts, windows, before) of all segments of some texts at the first level: as ``segments``, for all runs at once."""
    data = b"".join(texts)
    if len(texts) == 1:
        place, first, last = minimizer_runs(np.frombuffer(data, np.uint8), match)
        owner = np.zeros(len(place), np.int64)
    else:
        owner, place, first, last = runs_of(texts, match)
    cell = cells(match)[0]
    low = (place - last) // cell
    many = (place - first) // cell - low + 1
    run = np.repeat(np.arange(len(place)), many)
    c = np.arange(len(run)) - np.repeat(np.cumsum(many) - many, many) + low[run]
    place, owner = place[run], owner[run]
    core = place - c * cell
    start, end = np.maximum(first[run], core - cell + 1), np.minimum(last[run], core)
    keys = [xxh3_64_intdigest(data[i : i + match + 1 - cell], k) for i, k in zip(core.tolist(), c.tolist(), strict=True)]
    contents = [xxh3_128_digest(data[a:b]) for a, b in zip(start.tolist(), (end + match).tolist(), strict=True)]
    at = np.cumsum([0, *map(len, texts)])[owner]
    return owner.tolist(), np.array(keys, np.uint64).view(np.int64).tolist(), contents, (start - at).tolist(), (end - start + 1).tolist(), (place - start).tolist()


def _as_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def occurrences(docs: DataFrame, match: int = MATCH) -> DataFrame:
    """(doc, body, key, content, start, windows, before) for each segment of each row; ``before`` leads from its start to its minimizer."""

    def make():
        def step(batch: dict | None) -> Iterator[dict]:
            if not batch:
                return
            names = ("key", "content", "start", "windows", "before")
            rows = [(doc, body, data) for doc, body, text in zip(batch["doc"], batch["body"], batch["text"], strict=True) if len(data := _as_bytes(text)) >= match]
            at = 0
            while at < len(rows):
                to, size = at + 1, len(rows[at][2])
                while to < len(rows) and size + len(rows[to][2]) <= TOGETHER:
                    size += len(rows[to][2])
                    to += 1
                owner, *columns = all_segments([r[2] for r in rows[at:to]], match)
                yield {"doc": [rows[at + i][0] for i in owner], "body": [rows[at + i][1] for i in owner]} | dict(zip(names, columns, strict=True))
                at = to

        return step

    return map_batches(_keyed(docs).select("doc", "body", "text"), make, "doc long, body long, key long, content binary, start long, windows int, before int")


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumn("doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID))).withColumn("body", F.xxhash64("text"))


def _fetched(docs: DataFrame, wanted: DataFrame, match: int) -> DataFrame:
    """The bytes of one occurrence of each content: (key, content, windows, before, n, bytes)."""
    lists = wanted.groupBy("at.doc", "at.body").agg(F.collect_list(F.struct("key", "content", "windows", "n", F.col("at.start").alias("start"), F.col("at.before").alias("before"))).alias("items"))
    joined = _keyed(docs).select("doc", "body", "text").join(lists.hint("shuffle_hash"), ["doc", "body"])

    def make():
        def step(batch: dict | None) -> Iterator[dict]:
            if not batch:
                return
            for text, items in zip(batch["text"], batch["items"], strict=True):
                data = _as_bytes(text)
                yield {
                    "key": [x["key"] for x in items], "content": [x["content"] for x in items], "windows": [x["windows"] for x in items], "n": [x["n"] for x in items],
                    "before": [x["before"] for x in items], "bytes": [data[x["start"] : x["start"] + x["windows"] + match - 1] for x in items],
                }

        return step

    # Repeated rows give the same bytes again.
    return map_batches(joined.select("text", "items"), make, "key long, content binary, windows int, n long, before int, bytes binary").dropDuplicates(["key", "content"])


def repeated_starts(bodies: list[bytes], match: int = MATCH) -> list[np.ndarray]:
    """For each byte string: which starts have their ``match`` bytes starting elsewhere in the strings too."""
    sizes = np.array([len(b) + 1 for b in bodies])
    t = np.frombuffer(b"\0".join(bodies), np.uint8).astype(np.int64) + 2
    ends = np.cumsum(sizes) - 1
    t = np.append(t, 0)
    t[ends[:-1]] = 1
    sa = suffix_array(t, 258)
    plcp, phi = common_prefixes(t, sa, match)
    hit = np.flatnonzero(plcp >= match)
    marked = np.zeros(len(t), bool)
    marked[hit] = True
    marked[phi[hit]] = True
    return np.split(marked[:-1], ends[:-1] + 1)


def _shard_results(rows: DataFrame, n_shards: int, match: int) -> DataFrame:
    """(key, content, runs) of the contents that share ``match`` bytes with another content of their key."""
    dealt = rows.withColumn("shard", F.pmod(F.xxhash64("key"), F.lit(n_shards)).cast("int")).repartition(n_shards, "shard").sortWithinPartitions("shard", "key", "content")

    def make():
        held: dict[str, list] = {"shard": [], "key": [], "content": [], "windows": [], "bytes": []}

        def work() -> Iterator[dict]:
            out: dict[str, list] = {"key": [], "content": [], "runs": []}
            for i, marks in enumerate(repeated_starts(held["bytes"], match)):
                marks = marks[: held["windows"][i]]
                edge = np.flatnonzero(np.diff(np.concatenate([[0], marks.astype(np.int8), [0]])))
                if len(edge):
                    out["key"].append(held["key"][i])
                    out["content"].append(held["content"][i])
                    out["runs"].append([{"first": a, "many": b - a} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)])
            if out["key"]:
                yield out

        def step(batch: dict | None) -> Iterator[dict]:
            if batch is None:
                if held["shard"]:
                    yield from work()
                return
            for row in zip(*(batch[k] for k in held), strict=True):
                if held["shard"] and held["shard"][-1] != row[0]:
                    yield from work()
                    for v in held.values():
                        v.clear()
                for v, x in zip(held.values(), row, strict=True):
                    v.append(x)

        return step

    return map_batches(dealt.select("shard", "key", "content", "windows", "bytes"), make, "key long, content binary, runs array<struct<first:int,many:int>>")


def _split(rows: DataFrame, level: int, match: int) -> DataFrame:
    """The rows' windows in the cells of the next level, with the row that each comes from."""

    def make():
        def step(batch: dict | None) -> Iterator[dict]:
            if not batch:
                return
            out: dict[str, list] = {k: [] for k in ("from_key", "from_content", "shift", "key", "content", "windows", "n", "before", "bytes")}
            for key, content, windows, n, before, data in zip(*(batch[k] for k in ("key", "content", "windows", "n", "before", "bytes")), strict=True):
                for new, digest, a, many in segments(data, before, 0, windows - 1, level, match=match):
                    for k, v in zip(out, (key, content, a, new, digest, many, n, before - a, data[a : a + many + match - 1]), strict=True):
                        out[k].append(v)
            yield out

        return step

    return map_batches(rows.select("key", "content", "windows", "n", "before", "bytes"), make, "from_key long, from_content binary, shift int, key long, content binary, windows int, n long, before int, bytes binary")


def _marked(rows: DataFrame, level: int, match: int) -> DataFrame:
    """(key, content, runs) for distinct contents with bytes; recurs for keys of too many bytes."""
    size = F.col("windows").cast("long") + match
    weights = stored(rows.groupBy("key").agg(F.sum(size).alias("weight"), F.count("*").alias("contents")).where("contents > 1"), "weights")
    total = weights.where(F.col("weight") <= SHARD).agg(F.sum("weight")).first()[0] or 0
    small = rows.join(weights.where(F.col("weight") <= SHARD).select("key"), "key")
    found = _shard_results(small, max(1, -(-total // SHARD)), match)
    if level + 1 < len(cells(match)) and not weights.where(F.col("weight") > SHARD).isEmpty():
        parts = stored(_split(rows.join(weights.where(F.col("weight") > SHARD).select("key"), "key"), level + 1, match), "split")
        # Equal parts of different contents are repeats; they are one from here on.
        once = stored(parts.groupBy("key", "content").agg(F.max("windows").alias("windows"), F.sum("n").alias("n"), F.max("before").alias("before"), F.min("bytes").alias("bytes")), "once")
        whole = once.where("n > 1").select("key", "content", F.array(F.struct(F.lit(0).alias("first"), F.col("windows").alias("many"))).alias("runs"))
        below = stored(whole.unionByName(_marked(once, level + 1, match)), "below")
        moved = F.transform("runs", lambda r: F.struct((r["first"] + F.col("shift")).alias("first"), r["many"].alias("many")))
        found = found.unionByName(parts.select("from_key", "from_content", "shift", "key", "content").join(below, ["key", "content"]).select(F.col("from_key").alias("key"), F.col("from_content").alias("content"), moved.alias("runs")))
    return found


def repeated_spans(docs: DataFrame, match: int = MATCH) -> DataFrame:
    """(doc, body, spans): for each text the (from, to) bytes that repeated strings cover, unmerged."""
    spark = docs.sparkSession
    with passing(spark) as lasting:
        occ = stored(occurrences(docs, match), "segments")
        often = stored(occ.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "keys")
        shared = lasting(occ.join(F.broadcast(often) if often.count() <= FEW else often, "key"), "shared")
    with passing(spark) as lasting:
        contents = stored(shared.groupBy("key", "content").agg(F.count("*").alias("n"), F.max("windows").alias("windows"), F.min(F.struct("doc", "body", "start", "before")).alias("at")), "contents")
        several = stored(contents.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "several")
        rows = stored(_fetched(docs, contents.join(several, "key"), match), "bytes")
        whole = contents.where("n > 1").select("key", "content", F.array(F.struct(F.lit(0).alias("first"), F.col("windows").alias("many"))).alias("runs"))
        runs = lasting(whole.unionByName(_marked(rows, 0, match)), "runs")
    cover = F.transform("runs", lambda r: F.struct((F.col("start") + r["first"]).alias("from"), (F.col("start") + r["first"] + r["many"] + (match - 1)).alias("to")))
    found = shared.select("doc", "body", "key", "content", "start").join(runs, ["key", "content"]).select("doc", "body", F.explode(cover).alias("span"))
    return found.groupBy("doc", "body").agg(F.collect_set("span").alias("spans"))


def merged(spans: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs covered by the spans, in order."""
    out: list[list[int]] = []
    for a, b in sorted((s["from"], s["to"]) for s in spans or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def without_repeats(docs: DataFrame, texts: bool = True, match: int = MATCH) -> DataFrame:
    """All columns of ``docs`` with n_bytes, n_removed, n_spans and kept_sha256, and, with ``texts``, the text left.

    A null text counts as empty and stays null; texts under ``match`` bytes never
    change; a character that is cut in two is dropped from the text (never from
    the digest).  Repeated rows repeat each other and lose all their windows;
    null doc_ids are like any other.  Columns of these names are replaced.
    """
    names = ["n_bytes", "n_removed", "n_spans", "kept_sha256"]
    own = docs.drop(*names, "doc", "body", "spans")
    with passing(docs.sparkSession) as lasting:
        spans = lasting(repeated_spans(docs.select("doc_id", "text"), match), "spans")
    joined = _keyed(own).join(spans.hint("shuffle_hash"), ["doc", "body"], "left")
    kept = own.columns if texts else ["doc_id"]
    columns = list(dict.fromkeys([*kept, "text", "spans"]))
    schema = ", ".join(f"`{c}` {own.schema[c].dataType.simpleString()}" for c in kept)

    def make():
        def step(batch: dict | None) -> Iterator[dict]:
            if not batch:
                return
            out: dict[str, list] = {c: batch[c] for c in kept} | {c: [] for c in names}
            left: list[str | None] = []
            for text, found in zip(batch["text"], batch["spans"], strict=True):
                data, runs = _as_bytes(text), merged(found)
                rest = data
                if runs:
                    rest = b"".join(data[a:b] for a, b in zip([0, *(b for _, b in runs)], [*(a for a, _ in runs), len(data)], strict=True))
                    text = rest.decode("utf-8", "ignore")
                left.append(text)
                for c, v in zip(names, (len(data), len(data) - len(rest), len(runs), hashlib.sha256(rest).hexdigest()), strict=True):
                    out[c].append(v)
            if texts:
                out["text"] = left
            yield out

        return step

    return map_batches(joined.select(*columns), make, f"{schema}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
