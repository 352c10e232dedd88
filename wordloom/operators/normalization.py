"""Normalisation of tokens by ordered rules, and by their types."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODES = {
    "words_only": ("word", ""),
    "card_types": ("word|card.*", ""),
    "card_literals": ("word", "card.*"),
    "nonword_types": (".*", ""),
    "nonword_literals": ("word", ".*"),
}
"""Which types of tokens are normalised, and which of the others stay as they are; a token without a type is a word."""


def by_rules(tokens: DataFrame, rules: list[tuple[str, str]], text: str = "w", to: str = "norm") -> DataFrame:
    """``to``: what the first rule (pattern, replacement) whose pattern is found in the text makes of it; texts that none fits stay.

    A replacement takes the place of every match, and may refer to the groups of
    its pattern by ``$1`` and so on.  Rules are a list that the caller sets, and
    become one expression.
    """
    out = F.col(text)
    for pattern, replacement in reversed(rules):
        out = F.when(F.col(text).rlike(pattern), F.regexp_replace(text, F.lit(pattern), F.lit(replacement))).otherwise(out)
    return tokens.withColumn(to, out)


def typed(tokens: DataFrame, mode: str, text: Column, kind: str = "type", to: str = "norm") -> DataFrame:
    """The tokens that a ``MODES`` entry keeps, with ``to``: ``text`` of a word, ``@<TYPE>`` of another type that is normalised, or the token's own ``w``."""
    changed, literal = MODES[mode]
    of = F.coalesce(F.col(kind), F.lit("word"))
    is_changed, is_literal = of.rlike(f"^(?:{changed})$"), of.rlike(f"^(?:{literal})$") if literal else F.lit(False)
    new = F.when(is_changed & (of == "word"), text).when(is_changed, F.concat(F.lit("@"), F.upper(of))).otherwise(F.col("w"))
    return tokens.where(is_changed | is_literal).withColumn(to, new)
