"""Counts that are kept up to date over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.corpus import keep_known, sentences, tokens


def word_counts(docs: DataFrame) -> DataFrame:
    """(w, f) of a stream of documents, for the output modes complete and update."""
    return tokens(sentences(docs, ("doc_id",))).groupBy("w").agg(F.count("*").alias("f"))


def known_words(docs: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Tokens of a stream that a static vocabulary holds: a stateless stream-static join."""
    return keep_known(tokens(sentences(docs, ("doc_id",))), vocabulary)


def event_windows(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, event_type, n, total) for each window of event time; rows later than ``late`` are dropped in a stream."""
    timed = events.withWatermark("ts", late) if events.isStreaming else events
    return timed.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
