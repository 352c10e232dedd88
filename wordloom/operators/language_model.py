"""N-gram language models: sentence scores and corpus information."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .corpus import padded, windows

UNSEEN_WORD, UNSEEN_GRAM = 1e-3, 1e-5


def unigram_scores(toks: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, logp): the sum of ln p over a sentence's tokens; ``model`` is (w, p), unknown words get a fixed p."""
    met = toks.join(model.select("w", "p"), "w", "left")
    return met.groupBy(*keys).agg(F.sum(F.log(F.coalesce("p", F.lit(UNSEEN_WORD)))).alias("logp"))


def bigram_scores(sents: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, logp) under ``model`` (w1, w2, p), edge marks included."""
    pairs = sents.select(*keys, F.explode(windows(padded("toks", 1, 1), 2)).alias("g")).select(*keys, "g.w1", "g.w2")
    met = pairs.join(model.select("w1", "w2", "p"), ["w1", "w2"], "left")
    return met.groupBy(*keys).agg(F.sum(F.log(F.coalesce("p", F.lit(UNSEEN_GRAM)))).alias("logp"))


def trigram_scores(sents: DataFrame, model: DataFrame, keys: list[str]) -> DataFrame:
    """(keys…, logp) under ``model`` (w1, w2, w3, p), after two edge marks and up to one."""
    grams = sents.select(*keys, F.explode(windows(padded("toks", 2, 1), 3)).alias("g")).select(*keys, "g.*")
    # A trigram that a sentence repeats meets the model once.
    times = grams.groupBy(*keys, "w1", "w2", "w3").agg(F.count("*").alias("times"))
    met = times.join(model.select("w1", "w2", "w3", "p"), ["w1", "w2", "w3"], "left")
    return met.groupBy(*keys).agg(F.sum(F.col("times") * F.log(F.coalesce("p", F.lit(UNSEEN_GRAM)))).alias("logp"))


def corpus_information(scores: DataFrame, tokens: DataFrame) -> DataFrame:
    """(sum_logp, log_sum_p, sentences, tokens, entropy): of scored sentences, the sum of probabilities added in the log domain."""
    most = F.broadcast(scores.agg(F.max("logp").alias("m")))
    parts = scores.crossJoin(most).groupBy("m").agg(F.sum("logp").alias("sum_logp"), F.sum(F.exp(F.col("logp") - F.col("m"))).alias("s"), F.count("*").alias("sentences"))
    return parts.crossJoin(tokens.agg(F.count("*").alias("tokens"))).select("sum_logp", (F.col("m") + F.log("s")).alias("log_sum_p"), "sentences", "tokens", (-F.col("sum_logp") / F.log(F.lit(2.0)) / F.col("tokens")).alias("entropy"))


def interpolation_weights(bigrams: DataFrame) -> DataFrame:
    """(l1, l2): deleted-interpolation weights; each bigram's count goes to the better of its two leave-one-out estimates."""
    total = F.broadcast(bigrams.agg(F.sum("f").alias("n")))
    one = bigrams.groupBy(F.col("w1").alias("w1")).agg(F.sum("f").alias("f1"))
    two = bigrams.groupBy(F.col("w2").alias("w2")).agg(F.sum("f").alias("f2"))
    met = bigrams.join(one, "w1").join(two, "w2").crossJoin(total)
    conditional = F.when(F.col("f1") > 1, (F.col("f") - 1) / (F.col("f1") - 1)).otherwise(0.0)
    plain = F.when(F.col("n") > 1, (F.col("f2") - 1) / (F.col("n") - 1)).otherwise(0.0)
    wins = met.agg(F.sum(F.when(plain >= conditional, F.col("f")).otherwise(0)).alias("a"), F.sum(F.when(conditional > plain, F.col("f")).otherwise(0)).alias("b"))
    return wins.select((F.col("a") / (F.col("a") + F.col("b"))).alias("l1"), (F.col("b") / (F.col("a") + F.col("b"))).alias("l2"))
