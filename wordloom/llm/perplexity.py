"""Quality rules and n-gram perplexity (operator 3).

A text is read as its words with one space between them, after ``ORDER - 1``
start marks and before an end mark.  A modified Kneser-Ney model of ``ORDER``
characters, across words and over every character there is, is counted by Spark
for each language over the whole table, so it grows with the table.

A model of up to ``BROADCAST`` grams is sent to the tasks as a sorted array of
hashes.  A larger one is never in one place: the grams of each partition of the
table are known from the counting; they are joined with the model, and a
partition's texts meet the log probabilities of their own grams, again as sorted
arrays of hashes.  Both ways give the same scores.  As every gram scored has been counted as well, a gram's log probability is that
without its own place (leaving one out): what only one text holds is as
unlikely as if it were new.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import stored

ORDER = 4
START, END = "\x02", "\x03"
"""Marks; where a text holds them they are read as U+FFFD."""
SPREAD = 3.0
"""How many interquartile ranges beyond the quartiles a language's band reaches."""
LENGTH_SCALE = 10_000
"""Characters at which chance alone moves a document's mean as much as its style does; shorter ones vary more."""
TOGETHER = 2_000_000
"""Characters that are read at once; longer texts are read in parts that follow each other."""
BROADCAST = 4_000_000
"""Most grams of a model that is broadcast, at 16 bytes each."""
HELD = 2_000_000
"""Different grams that a task counts before it gives them out."""

_ODD_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")
_WORDS = re.compile("[^\x20\x09-\x0d]+")
_SPACE = re.compile("[\x20\x09-\x0d]")
_SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = "#*$%&|<>"
_BITS = 64 // ORDER
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    """The words of a text: runs of other than the six ASCII white-space characters."""
    return _WORDS.findall(text) if _ODD_SPACE.search(text) else text.split()


def repeated_words(words: list[str], window: int = 8) -> int:
    """How many words lie in windows of ``window`` (a power of two) words found twice or more."""
    n = len(words)
    if n <= window:
        return 0
    number: dict[str, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    size = 1
    while size < window:  # the windows of twice the size, numbered by pairs of numbers
        pair = ids[:-size] * n + ids[size:]
        size *= 2
        _, ids, counts = np.unique(pair, return_inverse=True, return_counts=True)
        if len(counts) == len(pair):
            return 0
    starts = np.flatnonzero(counts[ids] > 1)
    cover = np.zeros(n + 1, np.int64)
    np.add.at(cover, starts, 1)
    np.add.at(cover, starts + window, -1)
    return int((np.cumsum(cover) > 0).sum())


def duplicate_lines(text: str) -> int:
    """How many lines with a word equal an earlier one."""
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return len(lines) - len(set(lines))


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a text."""
    words = words_of(text)
    return len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, _SYMBOLS)), duplicate_lines(text), repeated_words(words)


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _FACTOR
    return h ^ (h >> np.uint64(29))


def _run_hashes(points: np.ndarray, begin: np.ndarray, silent: np.ndarray | None = None) -> np.ndarray:
    """A hash of each run of code points, from its begin to the next run's; ``silent`` ones say nothing."""
    if not len(begin):
        return np.zeros(0, np.uint64)
    size = np.diff(np.append(begin, len(points)))
    inside = np.arange(len(points)) - np.repeat(begin, size)
    value = _mixed(points.astype(np.uint64) + np.uint64(1)) * np.cumprod(np.full(int(size.max()), _FACTOR))[inside]
    if silent is not None:
        value[silent] = 0
    return _mixed(np.add.reduceat(value, begin))


def _holds_twice(hashes: np.ndarray, owner: np.ndarray, many: int) -> np.ndarray:
    """Which of the owners hold a hash twice."""
    out = np.zeros(many, bool)
    salted = hashes ^ _mixed(owner.astype(np.uint64) + np.uint64(1))
    order = np.argsort(salted)
    out[owner[order[1:]][salted[order[1:]] == salted[order[:-1]]]] = True
    return out


def all_base_counts(texts: list[str]) -> np.ndarray:
    """``base_counts`` of each text, a row each; only texts that seem to repeat a line or a window are looked at by themselves."""
    out = np.zeros((len(texts), 5), np.int64)
    if not texts:
        return out
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    at = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    space = (points == 32) | ((points >= 9) & (points <= 13))
    table = np.zeros(128, bool)
    table[[ord(c) for c in _SYMBOLS]] = True
    symbol = table[np.minimum(points, 127)] & (points < 127)
    opens = np.zeros(len(points) + 1, bool)
    opens[at] = True
    begins = ~space
    begins[1:] &= space[:-1] | opens[1:-1]
    for column, flags in ((0, begins), (1, ~space), (2, symbol)):
        total = np.concatenate([[0], np.cumsum(flags)])
        out[:, column] = total[at[1:]] - total[at[:-1]]
    # Lines with a word.
    breaks = points == 10
    begin = np.flatnonzero(opens[:-1] | np.concatenate([[False], breaks[:-1]])) if len(points) else np.zeros(0, np.int64)
    if len(begin):
        filled = np.add.reduceat(~space, begin, dtype=np.int64) > 0
        owner = np.searchsorted(at, begin, "right") - 1
        for i in np.flatnonzero(_holds_twice(_run_hashes(points, begin, breaks)[filled], owner[filled], len(texts))).tolist():
            out[i, 3] = duplicate_lines(texts[i])
    # Windows of eight words.
    hashes = _run_hashes(points[~space], np.flatnonzero(begins[~space]))
    n = len(hashes) - 7
    if n > 1:
        owner = np.repeat(np.arange(len(texts)), out[:, 0])
        window = np.zeros(n, np.uint64)
        for i in range(8):
            window = window * _FACTOR + hashes[i : i + n]
        whole = owner[:n] == owner[7:]
        for i in np.flatnonzero(_holds_twice(_mixed(window[whole]), owner[:n][whole], len(texts))).tolist():
            out[i, 4] = repeated_words(words_of(texts[i]))
    return out


def parts_of(text: str, size: int = 0) -> list[tuple[str, str, bool]]:
    """(lead, part, whether it ends the text): a text's words in parts of about ``size`` characters.

    The lead is what the first characters of the part are predicted from.
    """
    size = size or TOGETHER
    text = text.strip(_SPACES)
    if not text:
        return []
    out, lead, at = [], START * (ORDER - 1), 0
    while True:
        cut = _SPACE.search(text, at + size)
        part = text[at : cut.start()] if cut else text[at:]
        out.append((lead, part, cut is None))
        if not cut:
            return out
        if out[-1][1].strip(_SPACES):
            tail, want = " ".join(words_of(part[-2000:])), ORDER - 1
            lead = (tail if len(tail) >= want else (lead + ("" if lead[0] == START else " ") + " ".join(words_of(part))))[-want:]
        at = cut.start()


def gram_ends(parts: list[tuple[str, str, bool]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, ends, owner): the code points read, and of each gram its last place and its part."""
    points = np.frombuffer("".join(p for _, p, _ in parts).encode("utf-32-le", "surrogatepass"), "<u4")
    owner = np.repeat(np.arange(len(parts)), [len(p) for _, p, _ in parts])
    space = (points == 32) | ((points >= 9) & (points <= 13))
    first = np.zeros(len(points), bool)
    first[1:] = owner[1:] != owner[:-1]
    first[:1] = True
    begins = ~space
    begins[1:] &= space[:-1] | first[1:]
    own, begins, owner = points[~space], begins[~space], owner[~space]
    own = np.where((own == ord(START)) | (own == ord(END)), np.uint32(0xFFFD), own)
    opens = np.ones(len(own), bool)
    opens[1:] = owner[1:] != owner[:-1]
    closes = np.append(opens[1:], True)[: len(own)] & np.array([x for _, _, x in parts], bool)[owner]
    goes_on = opens & np.array([lead[0] != START for lead, _, _ in parts], bool)[owner]
    before = np.where(opens, ORDER - 1 + goes_on, begins)
    size = before + 1 + closes
    place = np.cumsum(size) - size + before
    symbols = np.full(int(size.sum()), 32, np.uint32)
    symbols[place] = own
    symbols[place[closes] + 1] = ord(END)
    predicted = np.ones(len(symbols), bool)
    if len(own):
        leads = np.frombuffer("".join(lead for lead, _, _ in (parts[i] for i in owner[opens].tolist())).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, ORDER - 1)
        at = (place[opens] - before[opens])[:, None] + np.arange(ORDER - 1)
        symbols[at] = leads
        predicted[at] = False
    ends = np.flatnonzero(predicted)
    return symbols, ends, np.repeat(owner, size)[ends]


def gram_hashes(columns: list[np.ndarray], lang: str) -> np.ndarray:
    """The hashes of the grams of a language whose characters are ``columns``, as signed integers."""
    from xxhash import xxh3_64_intdigest

    h = np.full(len(columns[0]), xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass")), np.uint64)
    for c in columns:
        h = _mixed(h ^ (c.astype(np.uint64) + np.uint64(1)) * _FACTOR)
    return h.view(np.int64)


def _groups(langs: list[str | None], texts: list[str | None]) -> Iterator[tuple[str, list[int], list[tuple[str, str, bool]]]]:
    """(language, rows, parts), about ``TOGETHER`` characters of one language at a time."""
    held: dict[str, tuple[list[int], list[tuple[str, str, bool]], int]] = {}
    for row, (lang, text) in enumerate(zip(langs, texts, strict=True)):
        for part in parts_of(text or ""):
            rows, parts, size = held.get(lang or "", ([], [], 0))
            rows.append(row)
            parts.append(part)
            size += len(part[1])
            if size >= TOGETHER:
                yield lang or "", rows, parts
                held.pop(lang or "", None)
            else:
                held[lang or ""] = rows, parts, size
    for lang, (rows, parts, _) in held.items():
        yield lang, rows, parts


class GramCounter:
    """Counts grams by language; characters have numbers, so a gram is one integer."""

    def __init__(self):
        self.numbers = np.zeros(0x110000, np.int64)
        self.chars = [0]
        self.held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        self.size = 0

    def add(self, lang: str, parts: list[tuple[str, str, bool]]) -> Iterator[dict]:
        symbols, ends, _ = gram_ends(parts)
        there = np.flatnonzero(np.bincount(symbols))
        fresh = there[self.numbers[there] == 0]
        if len(self.chars) + len(fresh) > 1 << _BITS:
            yield from self.given_out()
            if len(there) >= 1 << _BITS:  # more characters than numbers
                if len(parts) > 1:
                    yield from self.add(lang, parts[::2])
                    yield from self.add(lang, parts[1::2])
                else:
                    rows, counts = np.unique(np.stack([symbols[ends - k] for k in range(ORDER - 1, -1, -1)], axis=1), axis=0, return_counts=True)
                    yield _gram_rows(lang, list(rows.T), counts)
                return
            fresh = there
        self.numbers[fresh] = np.arange(len(self.chars), len(self.chars) + len(fresh))
        self.chars += fresh.tolist()
        codes = self.numbers[symbols].astype(np.uint64)
        packed = np.zeros(len(ends), np.uint64)
        for k in range(ORDER - 1, -1, -1):
            packed = (packed << np.uint64(_BITS)) | codes[ends - k]
        found = np.unique(packed, return_counts=True)
        kept = self.held.setdefault(lang, [])
        kept.append(found)
        self.size += len(found[0])
        if sum(len(x) for x, _ in kept[1:]) > max(200_000, len(kept[0][0])):
            self.size -= sum(len(x) for x, _ in kept)
            self.held[lang] = [_summed(kept)]
            self.size += len(self.held[lang][0][0])
        if self.size > HELD:
            yield from self.given_out()

    def given_out(self) -> Iterator[dict]:
        chars = np.array(self.chars, np.uint32)
        mask = np.uint64((1 << _BITS) - 1)
        for lang, kept in self.held.items():
            packed, counts = _summed(kept)
            yield _gram_rows(lang, [chars[((packed >> np.uint64(_BITS * k)) & mask).astype(np.int64)] for k in range(ORDER - 1, -1, -1)], counts)
        self.numbers[self.chars] = 0
        self.chars, self.held, self.size = [0], {}, 0


def _summed(kept: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    if len(kept) == 1:
        return kept[0]
    grams, counts = (np.concatenate(x) for x in zip(*kept, strict=True))
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    begin = np.flatnonzero(np.concatenate([[True], grams[1:] != grams[:-1]]))
    return grams[begin], np.add.reduceat(counts, begin)


def _gram_rows(lang: str, columns: list[np.ndarray], counts: np.ndarray) -> dict:
    joined = np.stack(columns, axis=1).astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")
    return {"lang": [lang] * len(counts), "gram": [joined[i : i + ORDER] for i in range(0, len(joined), ORDER)], "h": gram_hashes(columns, lang), "n": counts}


def _frames(batches: Iterator[pa.RecordBatch], size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batches in slices of about ``size`` bytes."""
    for whole in batches:
        rows = max(1, size * whole.num_rows // max(1, whole.nbytes))
        for at in range(0, whole.num_rows, rows):
            yield whole.slice(at, rows)


def count_grams(docs: DataFrame) -> DataFrame:
    """(block, lang, gram, h, n): the grams of each partition of ``docs`` with their counts; a gram may have several rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, block = GramCounter(), 0

        def out(rows: dict) -> pa.RecordBatch:
            n = len(rows["n"])
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, block, np.int32)), pa.array(rows["lang"], pa.string()), pa.array(rows["gram"], pa.string()), pa.array(rows["h"]), pa.array(rows["n"], pa.int64())], names=["block", "lang", "gram", "h", "n"])

        for batch in _frames(batches):
            block = batch["block"][0].as_py()
            for lang, _, parts in _groups(batch["lang"].to_pylist(), batch["text"].to_pylist()):
                for rows in counter.add(lang, parts):
                    yield out(rows)
        for rows in counter.given_out():
            yield out(rows)

    return docs.select(F.spark_partition_id().alias("block"), "lang", "text").mapInArrow(run, "block int, lang string, gram string, h long, n long")


def _discounts(counts: DataFrame) -> DataFrame:
    """The three discounts of each language and order, from counts of counts."""
    by = counts.groupBy("lang", "k").agg(*[F.count(F.when(F.col("n") == i, 1)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)])
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    # Where a count of counts is missing, half of the lowest count is taken off.
    d = [F.when((F.col(f"n{i}") > 0) & (F.col("n1") > 0), F.least(F.greatest(i - (i + 1) * y * F.col(f"n{i + 1}") / F.col(f"n{i}"), F.lit(0.05)), F.lit(i - 0.05))).otherwise(F.lit(0.5)).alias(f"d{i}") for i in (1, 2, 3)]
    return by.select("lang", "k", *d)


def _cut(n):
    """What is taken off a count."""
    return F.when(n <= 0, F.lit(0.0)).when(n == 1, F.least(F.col("d1"), F.lit(1.0))).when(n == 2, F.col("d2")).otherwise(F.col("d3"))


def fit(grams: DataFrame) -> DataFrame:
    """(h, lang, gram, n, logp, rest) of each gram of full order: the log probability of its last character after the others.

    ``rest`` is the log probability without one of the gram's places.  Lower
    orders count the different characters that precede a gram, and the
    probability of the order below comes in with the mass that discounts leave.
    """
    top = grams.groupBy("h").agg(F.min("lang").alias("lang"), F.min("gram").alias("gram"), F.sum("n").alias("n"))
    counts = stored(top.withColumn("k", F.lit(ORDER)), "grams")
    level = counts
    levels = [counts.select("lang", "gram", "n", "k")]
    for k in range(ORDER - 1, 0, -1):
        level = stored(level.groupBy("lang", F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n")).withColumn("k", F.lit(k)), "grams")
        levels.append(level)
    joined = levels[0]
    for level in levels[1:]:
        joined = joined.unionByName(level)
    discounts = stored(_discounts(joined), "discounts")
    chars = stored(levels[-1].groupBy("lang").agg((1 / (F.count("*") + 1.0)).alias("p")), "chars")
    below = None
    for level in reversed(levels):
        k = ORDER - levels.index(level)
        told = level.join(discounts.where(F.col("k") == k).drop("k"), "lang").withColumn("context", F.substring("gram", 1, k - 1)).withColumn("cut", _cut(F.col("n")))
        by_context = Window.partitionBy("lang", "context")  # as many rows as a language has characters
        told = told.withColumn("total", F.sum("n").over(by_context)).withColumn("left", F.round(F.sum("cut").over(by_context), 9))
        told = told.withColumn("cut_less", _cut(F.col("n") - 1)).drop("d1", "d2", "d3")
        if below is None:
            met = told.join(chars.select("lang", F.col("p").alias("lower"), F.col("p").alias("lower_rest")), "lang")
        else:
            met = told.withColumn("short", F.substring("gram", 2, k - 1)).join(below.select("lang", F.col("gram").alias("short"), F.col("p").alias("lower"), F.col("rest").alias("lower_rest")), ["lang", "short"])
        p = (F.col("n") - F.col("cut") + F.col("left") * F.col("lower")) / F.col("total")
        # Without the place that is predicted; if it was the only one, the order below has one place less as well.
        under = F.when(F.col("n") == 1, F.col("lower_rest")).otherwise(F.col("lower"))
        rest = F.when(F.col("total") > 1, (F.col("n") - 1 - F.col("cut_less") + (F.col("left") - F.col("cut") + F.col("cut_less")) * under) / (F.col("total") - 1)).otherwise(under)
        below = stored(met.select("lang", "gram", "n", p.alias("p"), rest.alias("rest")), "level")
    return below.join(counts.select("lang", "gram", "h"), ["lang", "gram"]).select("h", "lang", "gram", "n", F.log("p").alias("logp"), F.log("rest").alias("rest"))


class SortedHashes:
    """The log probabilities of a block's grams, found by the grams' hashes in a sorted array."""

    def __init__(self, hashes: list[np.ndarray], values: list[np.ndarray]):
        h = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
        order = np.argsort(h)
        self.hashes = h[order]
        self.values = np.concatenate(values)[order] if values else np.zeros(0)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.hashes, wanted)
        if len(wanted) and (at.max() >= len(self.hashes) or (self.hashes[at] != wanted).any()):
            raise ValueError("a text holds grams that its partition was not counted with: read the table from files")
        return self.values[at]


SCORED = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, log_perplexity double"


def _measured(texts: list[str | None], langs: list[str | None], model: SortedHashes) -> tuple[np.ndarray, list[float | None]]:
    """The base counts of each text, and its log perplexity per predicted character; None without words."""
    whole = [t or "" for t in texts]
    counts, at = np.zeros((len(whole), 5), np.int64), 0
    while at < len(whole):
        to, size = at, 0
        while to < len(whole) and (to == at or size + len(whole[to]) <= TOGETHER):
            size += len(whole[to])
            to += 1
        counts[at:to] = all_base_counts(whole[at:to]) if size <= TOGETHER else [base_counts(whole[at])]
        at = to
    total, many = np.zeros(len(whole)), np.zeros(len(whole), np.int64)
    for lang, rows, parts in _groups(langs, whole):
        symbols, ends, owner = gram_ends(parts)
        logs = model.find(gram_hashes([symbols[ends - k] for k in range(ORDER - 1, -1, -1)], lang))
        begin = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
        which = np.array(rows)[owner[begin]]
        np.add.at(total, which, np.add.reduceat(logs, begin))
        np.add.at(many, which, np.diff(np.append(begin, len(ends))))
    return counts, [round(-t / n, 9) if n else None for t, n in zip(total.tolist(), many.tolist(), strict=True)]


def scored(docs: DataFrame, extra: list[str], grams: DataFrame, model: DataFrame) -> DataFrame:
    """The columns ``extra`` with the base counts and the log perplexity of each row.

    ``grams`` is ``count_grams`` of the same frame, whose partitions must come
    out alike each time, as those of files do.
    """
    if model.count() <= BROADCAST:
        return _scored_everywhere(docs, extra, model)
    return _scored_by_partition(docs, extra, grams, model)


def _scored_everywhere(docs: DataFrame, extra: list[str], model: DataFrame) -> DataFrame:
    """As above, with the whole model in every task."""
    table = model.select("h", "rest").toArrow()
    sent = docs.sparkSession.sparkContext.broadcast(SortedHashes([table["h"].to_numpy()], [table["rest"].to_numpy()]))
    schema = StructType([*(docs.schema[c] for c in extra), *StructType.fromDDL(SCORED).fields])
    at = [f"_{i}" for i in range(len(extra))]
    rows = docs.select(*[F.col(c).alias(n) for c, n in zip(extra, at, strict=True)], F.col("lang").alias("lang"), F.col("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _frames(batches):
            counts, logs = _measured(part["text"].to_pylist(), part["lang"].to_pylist(), sent.value)
            yield pa.RecordBatch.from_arrays([*(part[n] for n in at), *(pa.array(c) for c in counts.T), pa.array(logs, pa.float64())], names=schema.fieldNames())

    return rows.mapInArrow(run, schema)


def _scored_by_partition(docs: DataFrame, extra: list[str], grams: DataFrame, model: DataFrame) -> DataFrame:
    """As above, each partition's texts brought together with the log probabilities of its grams."""
    own = [F.col(c) for c in extra]
    told = grams.select("block", "h").distinct().join(model.select("h", "rest"), "h")
    texts = docs.select(F.spark_partition_id().alias("_block"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_h"), F.lit(None).cast("double").alias("_logp"), F.col("lang").alias("_lang"), F.col("text").alias("_text"), F.struct(*own).alias("_own"))
    model_rows = told.select(F.col("block").alias("_block"), F.lit(0).alias("_kind"), F.col("h").alias("_h"), F.col("rest").alias("_logp"), F.lit(None).cast("string").alias("_lang"), F.lit(None).cast("string").alias("_text"), F.lit(None).cast(texts.schema["_own"].dataType).alias("_own"))
    met = model_rows.unionByName(texts).repartition("_block").sortWithinPartitions("_block", "_kind")
    kind = texts.schema["_own"].dataType
    schema = StructType([*kind.fields, *StructType.fromDDL(SCORED).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, model, held = None, None, ([], [])
        for batch in _frames(batches):
            blocks, kinds = batch["_block"].to_numpy(), batch["_kind"].to_numpy()
            cuts = np.flatnonzero((blocks[1:] != blocks[:-1]) | (kinds[1:] != kinds[:-1])) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(blocks)], strict=True):
                part = batch.slice(a, b - a)
                if blocks[a] != block:
                    block, model, held = blocks[a], None, ([], [])
                if kinds[a] == 0:
                    held[0].append(part["_h"].to_numpy())
                    held[1].append(part["_logp"].to_numpy())
                    continue
                if model is None:
                    model, held = SortedHashes(*held), ([], [])
                counts, logs = _measured(part["_text"].to_pylist(), part["_lang"].to_pylist(), model)
                yield pa.RecordBatch.from_arrays([*part["_own"].flatten(), *(pa.array(c) for c in counts.T), pa.array(logs, pa.float64())], names=schema.fieldNames())

    return met.mapInArrow(run, schema)


def judged(docs: DataFrame, extra: list[str], from_files: bool = False) -> DataFrame:
    """``extra``, the base counts, base_failed and kept for each row.

    A document's distance from its language's median log perplexity is divided
    by what chance allows at its length.  A language's band reaches ``SPREAD``
    interquartile ranges below and above the quartiles of these distances among
    its documents that pass the base rules.  Null texts have no words and fail;
    null languages count as the empty one; repeated rows are judged alike;
    an empty table gives no rows.  The rows are read twice and must come in the
    same partitions both times: they are written to the shared folder first,
    unless ``from_files`` says that they are a table's files already, at most
    with columns or rows left out.
    """
    if not from_files:
        docs = stored(docs.select(*dict.fromkeys([*extra, "lang", "text"])), "texts")
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    grams = stored(count_grams(docs), "grams")
    model = stored(fit(grams), "model")
    names = list(dict.fromkeys([*extra, "lang"]))
    table = stored(scored(docs, names, grams, model).withColumn("base_failed", failed).withColumn("_lang", F.coalesce("lang", F.lit(""))), "scored")
    middle = stored(table.where("not base_failed").groupBy("_lang").agg(F.percentile(F.round("log_perplexity", 4), F.lit(0.5)).alias("middle")), "middle")
    scale = F.sqrt(1 + LENGTH_SCALE / F.greatest(F.col("word_chars") + F.col("n_words"), F.lit(1)))
    table = table.join(middle, "_lang", "left").withColumn("distance", F.round((F.col("log_perplexity") - F.col("middle")) / scale, 5))
    bands = table.where("not base_failed").groupBy("_lang").agg(F.percentile("distance", F.lit(0.25)).alias("q1"), F.percentile("distance", F.lit(0.75)).alias("q3"))
    bands = stored(bands.select("_lang", (F.col("q1") - SPREAD * (F.col("q3") - F.col("q1"))).alias("low"), (F.col("q3") + SPREAD * (F.col("q3") - F.col("q1"))).alias("high")), "bands")
    met = table.join(bands, "_lang", "left")
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance").between(F.col("low"), F.col("high")), F.lit(False))
    return met.withColumn("kept", kept).select(*extra, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "log_perplexity", "distance", "low", "high")
