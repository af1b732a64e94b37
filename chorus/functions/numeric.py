"""Numeric expressions that Spark lacks, as SQL text (one expression tree to
parse, where the column functions would build it call by call)."""

from __future__ import annotations

DIGAMMA_SHIFT = 6


def digamma(x: str) -> str:
    """The digamma function of a positive expression: the recurrence moves
    the argument up by six, where the asymptotic series is good to 3e-9."""
    y = f"(({x}) + {DIGAMMA_SHIFT})"
    square = f"({y} * {y})"
    series = (f"ln({y}) - 1D / (2D * {y}) - 1D / (12D * {square}) + 1D / (120D * {square} * {square}) "
              f"- 1D / (252D * {square} * {square} * {square})")
    return "(" + series + "".join(f" - 1D / (({x}) + {i}D)" for i in range(DIGAMMA_SHIFT)) + ")"
