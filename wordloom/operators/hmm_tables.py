"""Hidden Markov models over vocabularies of any size.

States and their transitions are small arrays; the emissions are a table that
tokens are joined with, so no task holds the vocabulary.  Sentences are gathered
by their keys and worked on in blocks of like length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.storage import kept
from .corpus import EDGE, UNKNOWN

TOGETHER = 256
"""Sentences of like length that are worked on at once."""


@dataclass
class TableModel:
    tags: list[str]
    a: np.ndarray  # ln p(tag j | tag i)
    start: np.ndarray
    stop: np.ndarray
    emissions: DataFrame  # (w, e): ln p(w | tag) for each tag
    unknown: np.ndarray  # the same of all words that the table doesn't hold


def supervised_counts(tagged: DataFrame, keys: list[str], rare: int = 1) -> tuple[DataFrame, DataFrame]:
    """((w, tag, f), (t1, t2, f)): emissions, the mass of words seen ``rare`` times or fewer counting for the unknown word too, and transitions with edge marks."""
    lex = tagged.groupBy("w", "tag").agg(F.count("*").alias("f"))
    total = lex.groupBy("w").agg(F.sum("f").alias("all"))
    unknown = lex.join(total, "w").where(F.col("all") <= rare).groupBy("tag").agg(F.sum("f").alias("f")).select(F.lit(UNKNOWN).alias("w"), "tag", "f")
    order = tagged.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]).alias("t"))
    padded = F.concat(F.array(F.lit(EDGE)), F.col("t"), F.array(F.lit(EDGE)))
    pairs = order.select(F.explode(F.transform(F.sequence(F.lit(0), F.size("t")), lambda i: F.struct(F.get(padded, i).alias("t1"), F.get(padded, i + 1).alias("t2")))).alias("p")).select("p.*")
    return lex.unionByName(unknown), pairs.groupBy("t1", "t2").agg(F.count("*").alias("f"))


def emission_probabilities(lex: DataFrame, coefficient: float = 0.01) -> DataFrame:
    """(w, tag, p): p(w | tag) of counts (w, tag, f): a row for each pair that was seen, and one without a word for what every other word of the table has under a tag.

    Every joint probability, seen or not, gets ``coefficient`` times the least one added.
    """
    of_tag = F.broadcast(lex.groupBy("tag").agg(F.sum("f").alias("_of_tag")))
    other = of_tag.select(F.lit(None).cast("string").alias("w"), "tag", F.lit(0).cast("long").alias("f"))
    return _smoothed(lex.select("w", "tag", F.col("f")).unionByName(other).join(of_tag, "tag"), lex, coefficient)


def emission_grid(lex: DataFrame, coefficient: float = 0.01) -> DataFrame:
    """(w, tag, p): the same for every word of the table under every tag, seen together or not.

    The tags of a word, as few as there are tags, meet all tags in its one row; a null tag is one that no word is found under.
    """
    of_tag = F.broadcast(lex.groupBy("tag").agg(F.sum("f").alias("_of_tag")))
    seen = lex.groupBy("w").agg(F.map_from_entries(F.collect_list(F.when(F.col("tag").isNotNull(), F.struct("tag", "f")))).alias("_seen"))
    return _smoothed(seen.crossJoin(of_tag).select("w", "tag", F.coalesce(F.element_at("_seen", F.col("tag")), F.lit(0)).alias("f"), "_of_tag"), lex, coefficient)


def _smoothed(rows: DataFrame, lex: DataFrame, coefficient: float) -> DataFrame:
    """(w, tag, p) of counts (w, tag, f) with their tag's sum, by the sums of ``lex``."""
    sums = F.broadcast(lex.agg(F.sum("f").alias("_n"), F.min("f").alias("_least"), F.count_distinct("w").alias("_words")))
    add = coefficient * F.col("_least") / F.col("_n")
    return rows.crossJoin(sums).select("w", "tag", ((F.col("f") / F.col("_n") + add) / (F.col("_of_tag") / F.col("_n") + add * F.col("_words"))).alias("p"))


def with_unknown(lex: DataFrame, how: str, total: float = 1.0, coefficient: float = 0.01) -> DataFrame:
    """Emission counts (w, tag, f) in which the unknown word has some.

    ``none``     as they are
    ``uniform``  ``coefficient`` times the least count under every tag
    ``types``    ``total``, dealt to the tags by how many different words each has
    """
    if how == "none":
        return lex
    seen = lex.where((F.col("f") > 0) & (F.col("w") != UNKNOWN))
    if how == "uniform":
        new = seen.groupBy("tag").agg(F.min("f").alias("_m")).crossJoin(F.broadcast(seen.agg(F.min("f").alias("_least")))).select(F.lit(UNKNOWN).alias("w"), "tag", (coefficient * F.col("_least")).alias("f"))
    elif how == "types":
        types = seen.groupBy("tag").agg(F.count_distinct("w").alias("_n"))
        new = types.crossJoin(F.broadcast(types.agg(F.sum("_n").alias("_all")))).select(F.lit(UNKNOWN).alias("w"), "tag", (total * F.col("_n") / F.col("_all")).alias("f"))
    else:
        raise ValueError(f"no way of unknown words: {how}")
    known = lex.where(F.col("w") != UNKNOWN) if how == "types" else lex  # types set the unknown word's counts, a uniform share is added to them
    return known.select("w", "tag", F.col("f").cast("double").alias("f")).unionByName(new).groupBy("w", "tag").agg(F.sum("f").alias("f"))


def frozen(counts: DataFrame, given: str, power: float = 2.0) -> DataFrame:
    """Counts (…, f) whose shares p of what is ``given`` become p^power over their sum, each given thing keeping its total.

    For transitions (t1, t2, f) that is ``t1``, the edge mark for the starts; for
    emissions (w, tag, f) it is ``w``, so that each word's tags become surer.
    """
    whole = counts.groupBy(given).agg(F.sum("f").alias("_whole"))
    sharp = counts.join(whole, given).withColumn("_x", F.pow(F.col("f") / F.col("_whole"), F.lit(float(power))))
    sums = sharp.groupBy(given).agg(F.sum("_x").alias("_sum"))
    return sharp.join(sums, given).withColumn("f", F.col("_x") / F.col("_sum") * F.col("_whole")).select(*counts.columns)


def transition_probabilities(moves: DataFrame, coefficient: float = 0.01) -> DataFrame:
    """(t1, t2, p): p(t2 | t1) of counts (t1, t2, f) with edge marks, every pair of states that may follow each other smoothed as above."""
    left, right = moves.select("t1").distinct(), moves.select("t2").distinct()
    sums = F.broadcast(moves.agg(F.sum("f").alias("_n"), F.min("f").alias("_least")))
    grid = left.crossJoin(F.broadcast(right)).where(~((F.col("t1") == EDGE) & (F.col("t2") == EDGE))).join(moves, ["t1", "t2"], "left").crossJoin(sums)
    p = grid.select("t1", "t2", (F.coalesce("f", F.lit(0)) / F.col("_n") + coefficient * F.col("_least") / F.col("_n")).alias("p"))
    return p.withColumn("p", F.col("p") / F.sum("p").over(Window.partitionBy("t1")))  # as many rows as there are states


def compiled(lex: DataFrame, moves: DataFrame, coefficient: float = 0.01) -> TableModel:
    """The model of emission counts (w, tag, f), the unknown word among them, and transition counts (t1, t2, f)."""
    b = kept(emission_probabilities(lex, coefficient), "emissions")
    others = {r["tag"]: float(np.log(r["p"])) for r in b.where("w is null").collect()}  # a row for each tag
    t = transition_probabilities(moves, coefficient).toPandas()
    tags = sorted({*t["t1"], *t["t2"]} - {EDGE})
    at = {x: i for i, x in enumerate(tags)}
    a, start, stop = np.full((len(tags), len(tags)), -np.inf), np.full(len(tags), -np.inf), np.full(len(tags), -np.inf)
    for x, y, p in t[["t1", "t2", "p"]].itertuples(index=False):
        if x == EDGE:
            start[at[y]] = np.log(p)
        elif y == EDGE:
            stop[at[x]] = np.log(p)
        else:
            a[at[x], at[y]] = np.log(p)
    row = F.array(*[F.coalesce(F.log(F.max(F.when(F.col("tag") == x, F.col("p")))), F.lit(others.get(x, float(np.log(1e-12))))) for x in tags])
    rows = kept(b.where("w is not null").groupBy("w").agg(row.alias("e")), "rows")
    found = rows.where(F.col("w") == UNKNOWN).first()
    unknown = np.array(found["e"]) if found else np.full(len(tags), np.log(1e-12))
    return TableModel(tags, a, start, stop, rows.where(F.col("w") != UNKNOWN), unknown)


def best_tags(lex: DataFrame, q: int) -> DataFrame:
    """(w, tag, p, rank): the q likeliest tags of each word by p(tag | w)."""
    whole = lex.groupBy("w").agg(F.sum("f").alias("_all"))
    order = Window.partitionBy("w").orderBy(F.desc("f"), "tag")  # as many rows as a word has tags
    ranked = lex.join(whole, "w").withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= q)
    return ranked.select("w", "tag", (F.col("f") / F.col("_all")).alias("p"), "rank")


def restricted(lex: DataFrame, least: float) -> DataFrame:
    """Counts without the tags that a word has with a probability below ``least``."""
    whole = lex.groupBy("w").agg(F.sum("f").alias("_all"))
    return lex.join(whole, "w").where(F.col("f") >= least * F.col("_all")).drop("_all")


def frequencies(probabilities: DataFrame, totals: DataFrame, given: str, rounded: bool = False) -> DataFrame:
    """Probabilities p as expected counts f: times the total (``given``, n) of what they are conditioned on."""
    f = F.col("p") * F.col("n")
    return probabilities.join(totals, given).withColumn("f", F.floor(f + 0.5) if rounded else f).drop("n", "p")


def grown(model: TableModel, words: DataFrame) -> TableModel:
    """The model with new words (w), each as likely as the unknown word; all shares shrink so that they add up to 1 again."""
    new = kept(words.select("w").distinct().join(model.emissions.select("w"), "w", "left_anti"), "words")
    shrink = [float(x) for x in np.log1p(new.count() * np.exp(model.unknown))]
    less = lambda e: F.zip_with(e, F.lit(shrink), lambda x, y: x - y)
    unknown = model.unknown - np.array(shrink)
    rows = model.emissions.select("w", less(F.col("e")).alias("e")).unionByName(new.select("w", F.lit([float(x) for x in unknown]).alias("e")))
    return replace(model, emissions=kept(rows, "grown"), unknown=unknown)


def _emitted(sents: DataFrame, model: TableModel, keys: list[str]) -> DataFrame:
    """(keys…, toks, e): sentences with the emissions of their words."""
    toks = sents.select(*keys, F.posexplode("toks").alias("pos", "w"))
    met = toks.join(model.emissions, "w", "left").withColumn("e", F.coalesce("e", F.lit([float(x) for x in model.unknown])))
    inside = F.array_sort(F.collect_list(F.struct("pos", "w", "e")))
    return met.groupBy(*keys).agg(inside.alias("_x")).select(*keys, F.transform("_x", lambda x: x["w"]).alias("toks"), F.transform("_x", lambda x: x["e"]).alias("e"))


def _blocks(frame: pd.DataFrame) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, lengths, emissions) of sentences of like length; what lies beyond a sentence's end is 0."""
    sizes = np.array([len(t) for t in frame["toks"]])
    order = np.argsort(sizes, kind="stable")
    for lo in range(0, len(order), TOGETHER):
        rows = order[lo : lo + TOGETHER]
        lengths = sizes[rows]
        each = [np.stack(frame["e"].iloc[i]) for i in rows]
        e = np.zeros((len(rows), int(lengths.max()), each[0].shape[1]))
        for k, x in enumerate(each):
            e[k, : len(x)] = x
        yield rows, lengths, e


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    most = x.max(axis=axis, keepdims=True)
    most = np.where(np.isfinite(most), most, 0)
    with np.errstate(divide="ignore"):
        return (most + np.log(np.exp(x - most).sum(axis=axis, keepdims=True))).squeeze(axis)


def viterbi(m: TableModel, lengths: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(states, ln p) of the best path of each sentence of a block; ties to the lower state."""
    delta = m.start + e[:, 0]
    back = np.zeros(e.shape, np.int64)
    for k in range(1, e.shape[1]):
        step = delta[:, :, None] + m.a
        back[:, k] = step.argmax(axis=1)
        delta = np.where((k < lengths)[:, None], step.max(axis=1) + e[:, k], delta)
    delta = delta + m.stop
    path = np.zeros(e.shape[:2], np.int64)
    state = delta.argmax(axis=1)
    for k in range(e.shape[1] - 1, -1, -1):
        inside = k < lengths
        path[:, k] = np.where(inside, state, 0)
        state = np.where(inside, back[np.arange(len(e)), k, state], state) if k else state
    return path, delta.max(axis=1)


def forward_backward(m: TableModel, lengths: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ln alpha, ln beta, ln p) of each sentence of a block."""
    alpha, beta = np.zeros(e.shape), np.zeros(e.shape)
    alpha[:, 0] = m.start + e[:, 0]
    for k in range(1, e.shape[1]):
        alpha[:, k] = np.where((k < lengths)[:, None], _log_sum(alpha[:, k - 1][:, :, None] + m.a, 1) + e[:, k], alpha[:, k - 1])
    p = _log_sum(alpha[:, -1] + m.stop, 1)
    beta[:, -1] = m.stop
    for k in range(e.shape[1] - 2, -1, -1):
        beta[:, k] = np.where((k + 1 < lengths)[:, None], _log_sum(m.a + (e[:, k + 1] + beta[:, k + 1])[:, None, :], 2), m.stop)
    return alpha, beta, p


def tagged(sents: DataFrame, model: TableModel, keys: list[str], how: str = "viterbi") -> DataFrame:
    """(keys…, tags, logp) of sentences (keys…, toks): the best path, or the likeliest tag at each place by itself (``posterior``)."""
    fixed = replace(model, emissions=None)
    schema = ", ".join(f"{k} {sents.schema[k].dataType.simpleString()}" for k in keys)
    names = np.array(model.tags, object)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            tags: list = [None] * len(frame)
            logp = np.zeros(len(frame))
            for rows, lengths, e in _blocks(frame) if len(frame) else ():
                if how == "viterbi":
                    path, logp[rows] = viterbi(fixed, lengths, e)
                else:
                    alpha, beta, logp[rows] = forward_backward(fixed, lengths, e)
                    path = (alpha + beta).argmax(axis=2)
                for k, i in enumerate(rows.tolist()):
                    tags[i] = names[path[k, : lengths[k]]].tolist()
            yield frame[keys].assign(tags=tags, logp=logp)

    return _emitted(sents, model, keys).mapInPandas(run, f"{schema}, tags array<string>, logp double")


def expected_counts(sents: DataFrame, model: TableModel, keys: list[str]) -> DataFrame:
    """(kind, i, j, f): expected uses of starts, stops, transitions and emissions (i the tag, j the next tag or the word), ln p and the number of sentences."""
    fixed = replace(model, emissions=None)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = model_tags
        for frame in frames:
            if not len(frame):
                continue
            start, stop, a = np.zeros(len(names)), np.zeros(len(names)), np.zeros((len(names), len(names)))
            logp, words, shares = 0.0, [], []
            for rows, lengths, e in _blocks(frame):
                alpha, beta, p = forward_backward(fixed, lengths, e)
                gamma = np.exp(alpha + beta - p[:, None, None])
                start += gamma[:, 0].sum(axis=0)
                stop += gamma[np.arange(len(rows)), lengths - 1].sum(axis=0)
                logp += float(p.sum())
                for k in range(e.shape[1] - 1):
                    on = k + 1 < lengths
                    a += np.exp(alpha[on, k][:, :, None] + fixed.a + (e[on, k + 1] + beta[on, k + 1])[:, None, :] - p[on][:, None, None]).sum(axis=0)
                for k, i in enumerate(rows.tolist()):
                    words += list(frame["toks"].iloc[i])
                    shares.append(gamma[k, : lengths[k]])
            known, at = np.unique(np.array(words, object), return_inverse=True)
            b = np.zeros((len(known), len(names)))
            np.add.at(b, at, np.concatenate(shares))
            out = [("logp", "", "", logp), ("n", "", "", float(len(frame)))]
            out += [(kind, names[i], "", float(x[i])) for kind, x in (("start", start), ("stop", stop)) for i in range(len(names))]
            out += [("a", names[i], names[j], float(a[i, j])) for i in range(len(names)) for j in range(len(names))]
            w, t = np.nonzero(b)
            out += zip(["b"] * len(w), [names[i] for i in t], known[w].tolist(), b[w, t].tolist(), strict=True)
            yield pd.DataFrame(out, columns=["kind", "i", "j", "f"])

    model_tags = model.tags
    return _emitted(sents, model, keys).mapInPandas(run, "kind string, i string, j string, f double").groupBy("kind", "i", "j").agg(F.sum("f").alias("f"))


def reestimated(sents: DataFrame, model: TableModel, keys: list[str], floor: float = 1e-12) -> tuple[TableModel, float]:
    """The model after a round of expectation and maximisation, and ln p of the corpus before it; the emissions stay a table."""
    counts = kept(expected_counts(sents, model, keys), "expected")
    small = {(r["kind"], r["i"], r["j"]): r["f"] for r in counts.where("kind <> 'b'").collect()}  # as many rows as pairs of states
    tags = model.tags
    a = np.array([[small.get(("a", x, y), 0.0) + floor for y in tags] for x in tags])
    start, stop = (np.array([small.get((kind, x, ""), 0.0) + floor for x in tags]) for kind in ("start", "stop"))
    out = a.sum(axis=1) + stop
    b = counts.where("kind = 'b'").groupBy(F.col("j").alias("w")).agg(F.array(*[F.coalesce(F.sum(F.when(F.col("i") == x, F.col("f"))), F.lit(0.0)) + floor for x in tags]).alias("f"))
    known = kept(model.emissions.select("w").join(b, "w", "left").withColumn("f", F.coalesce("f", F.lit([floor] * len(tags)))), "emitted")
    fresh = b.join(model.emissions.select("w"), "w", "left_anti").agg(*[F.coalesce(F.sum(F.get("f", i)), F.lit(0.0)).alias(f"f{i}") for i in range(len(tags))]).first()
    rest = np.array([fresh[f"f{i}"] + floor for i in range(len(tags))])
    sums = known.agg(*[F.coalesce(F.sum(F.get("f", i)), F.lit(0.0)).alias(f"f{i}") for i in range(len(tags))]).first()
    whole = np.array([sums[f"f{i}"] for i in range(len(tags))]) + rest
    rows = known.select("w", F.zip_with("f", F.lit([float(x) for x in whole]), lambda x, y: F.log(x / y)).alias("e"))
    return TableModel(tags, np.log(a / out[:, None]), np.log(start / start.sum()), np.log(stop / out), kept(rows, "rows"), np.log(rest / whole)), small.get(("logp", "", ""), 0.0)


def trained(corpora: list[DataFrame], model: TableModel, keys: list[str], rounds: int = 20, tolerance: float = 1e-4) -> tuple[TableModel, list[float]]:
    """The model after rounds of re-estimation over all corpora together, and ln p before each; it ends when that rises by less than ``tolerance`` of itself.

    Each corpus has the columns (keys…, toks); keys may repeat between corpora.
    """
    together = None
    for i, sents in enumerate(corpora):
        one = sents.select(*keys, "toks", F.lit(i).alias("_corpus"))
        together = one if together is None else together.unionByName(one)
    together = kept(together, "corpora")
    history: list[float] = []
    for _ in range(rounds):
        model, logp = reestimated(together, model, [*keys, "_corpus"])
        history.append(logp)
        if len(history) > 1 and history[-1] - history[-2] < tolerance * abs(history[-2]):
            break
    return model, history
