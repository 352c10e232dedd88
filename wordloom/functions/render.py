"""Text renderings of small results, and variables that refer to each other."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

ROWS = 1000
"""Most rows that are rendered."""


def ascii_table(df: DataFrame, rows: int = ROWS) -> str:
    """The first rows as a table of text."""
    cells = [df.columns, *[["" if v is None else str(v) for v in r] for r in df.limit(rows).collect()]]
    sizes = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    lines = ["  ".join(c.ljust(n) for c, n in zip(r, sizes, strict=True)).rstrip() for r in cells]
    return "\n".join([lines[0], "-" * len(lines[0]), *lines[1:]]) + "\n"


def latex_table(df: DataFrame, rows: int = ROWS) -> str:
    """The first rows as a LaTeX tabular; special characters are escaped."""
    safe = lambda v: re.sub(r"([#$%&_{}])", r"\\\1", "" if v is None else str(v).replace("\\", r"\textbackslash "))
    body = [" & ".join(map(safe, r)) + r" \\" for r in [df.columns, *df.limit(rows).collect()]]
    return "\n".join([r"\begin{tabular}{" + "l" * len(df.columns) + "}", body[0], r"\hline", *body[1:], r"\end{tabular}"]) + "\n"


def expanded(variables: dict[str, str]) -> dict[str, str]:
    """Values with $(name) and ${name} replaced by what they name; unknown names are empty, circles are refused."""
    done: dict[str, str] = {}

    def value(name: str, above: tuple[str, ...]) -> str:
        if name in above:
            raise ValueError(f"{name} refers to itself")
        if name not in done:
            done[name] = re.sub(r"\$(?:\(([^)]*)\)|\{([^}]*)\})", lambda m: value(m[1] or m[2], (*above, name)), variables.get(name, ""))
        return done[name]

    return {n: value(n, ()) for n in variables}
