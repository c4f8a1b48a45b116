"""Recursions over ordered arrays, within the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Outputs that are gathered before they are handed on as one piece, so that appending stays cheap.
PIECE = 256


def scan_with_state(series: Column, state: Column, fields: list[str], step: Callable[[Column, Column], tuple[dict[str, Column], Column]], kind: str) -> Column:
    """A struct of ``out``, an output (of SQL type ``kind``) for each element of an array, in order, and ``state``, the state behind the last;
    ``step`` gives the next state and the output. ``state``: a struct of ``fields``."""

    def merge(acc: Column, x: Column) -> Column:
        new, out = step(acc, x)
        full = F.size(acc["__piece"]) >= PIECE
        return F.struct(
            *[new[k].alias(k) for k in fields],
            F.when(full, F.array(out)).otherwise(F.concat(acc["__piece"], F.array(out))).alias("__piece"),
            F.when(full, F.concat(acc["__pieces"], F.array(acc["__piece"]))).otherwise(acc["__pieces"]).alias("__pieces"),
        )

    empty = [F.array().cast(f"array<{kind}>").alias("__piece"), F.array().cast(f"array<array<{kind}>>").alias("__pieces")]
    first = F.struct(*[state[k].alias(k) for k in fields], *empty)
    ended = lambda z: F.struct(F.flatten(F.concat(z["__pieces"], F.array(z["__piece"]))).alias("out"), F.struct(*[z[k].alias(k) for k in fields]).alias("state"))
    return F.aggregate(series, first, merge, ended)


def scan(series: Column, start: dict[str, Column], step: Callable[[Column, Column], tuple[dict[str, Column], Column]], kind: str) -> Column:
    """An output (of SQL type ``kind``) for each element of an array, in order; ``step`` gives the next state and the output."""
    return scan_with_state(series, F.struct(*[v.alias(k) for k, v in start.items()]), list(start), step, kind)["out"]
