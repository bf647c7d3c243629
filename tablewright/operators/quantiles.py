"""Exact order statistics without ever sorting or holding a whole column in one task.

A histogram pass narrows every wanted rank to one bin. Bins still holding too many
rows are split again; a bin's bounds are the smallest and largest value seen in it, so
the next pass always works on the true extent. The last pass counts the distinct
values of the few remaining rows. Each pass shuffles at most bins x columns rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window, functions as F

from tablewright.functions.columns import as_double, chunks

BINS = 2048
KEEP_ROWS = 100_000
COLUMNS_PER_PASS = 16
LOG_RATIO = 1e6


@dataclass
class Bracket:
    """Rows of `column` within [low, high]; `below` rows come before them."""
    column: str
    low: float
    high: float
    below: int
    inside: int
    ranks: list[int] = field(default_factory=list)

    def bin_of(self, value: Column) -> Column:
        """Monotone bin number of a value in the bracket."""
        low, high = self.low, self.high
        if low > 0 and high / low > LOG_RATIO:
            position, start, stop = F.ln(value), math.log(low), math.log(high)
        elif high < 0 and low / high > LOG_RATIO:
            position, start, stop = -F.ln(-value), -math.log(-low), -math.log(-high)
        else:
            position, start, stop = value, low, high
        # Halved operands keep the extent finite for the widest double ranges.
        extent = stop / 2 - start / 2
        bin_number = F.floor((position / 2 - F.lit(start / 2)) / F.lit(extent) * BINS)
        return F.greatest(F.least(bin_number, F.lit(BINS - 1)), F.lit(0)).cast("int")


def _rows_in(df: DataFrame, brackets: list[Bracket], with_bins: bool) -> DataFrame:
    """(bracket, v[, bin]) for every value that lies in one of the brackets."""
    names = {b.column: f"v{i}" for i, b in enumerate({b.column: b for b in brackets}.values())}
    slim = df.select(*[as_double(df, c).alias(v) for c, v in names.items()])
    entries = []
    for i, b in enumerate(brackets):
        value = F.col(names[b.column])
        parts = [F.lit(i).alias("bracket"), value.alias("v")]
        if with_bins:
            parts.append(b.bin_of(value).alias("bin"))
        entries.append(F.when(value.between(F.lit(b.low), F.lit(b.high)), F.struct(*parts)))
    return slim.select(F.explode(F.array(*entries)).alias("e")).where("e is not null").select("e.*")


def _split(df: DataFrame, brackets: list[Bracket]) -> list[Bracket]:
    """One histogram pass: the sub-bracket of every wanted rank."""
    histogram = (_rows_in(df, brackets, True).groupBy("bracket", "bin")
                 .agg(F.count("*").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")))
    out = []
    per_bracket: dict[int, list] = {}
    for row in histogram.collect():  # at most BINS rows per bracket
        per_bracket.setdefault(row["bracket"], []).append(row)
    for i, b in enumerate(brackets):
        before = b.below
        for row in sorted(per_bracket[i], key=lambda r: r["bin"]):
            ranks = [k for k in b.ranks if before <= k < before + row["n"]]
            if ranks:
                out.append(Bracket(b.column, row["low"], row["high"], before, row["n"], ranks))
            before += row["n"]
    return out


def _resolve(df: DataFrame, brackets: list[Bracket]) -> dict[tuple[str, int], float]:
    """Values at the wanted ranks of brackets that hold few rows."""
    counted = _rows_in(df, brackets, False).groupBy("bracket", "v").agg(F.count("*").alias("n"))
    running = counted.withColumn(
        "upto", F.sum("n").over(Window.partitionBy("bracket").orderBy("v")))
    wanted = [(i, b, k) for i, b in enumerate(brackets) for k in b.ranks]
    row = running.agg(*[
        F.min(F.when((F.col("bracket") == i) & (F.col("upto") > k - b.below), F.col("v")))
        for i, b, k in wanted]).first()
    return {(b.column, k): row[j] for j, (_, b, k) in enumerate(wanted)}


def order_statistics(df: DataFrame, ranks: dict[str, list[int]], extents: dict,
                     keep_rows: int = KEEP_ROWS) -> dict[tuple[str, int], float]:
    """Value at each 0-based rank among the non-null values of each column.

    `extents` maps a column to (non-null count, min, max).
    """
    found: dict[tuple[str, int], float] = {}
    for group in chunks([c for c in ranks if ranks[c]], COLUMNS_PER_PASS):
        todo = [Bracket(c, extents[c][1], extents[c][2], 0, extents[c][0], sorted(set(ranks[c])))
                for c in group]
        ready: list[Bracket] = []
        while todo:
            wide = []
            for b in todo:
                if b.low == b.high:
                    found.update({(b.column, k): b.low for k in b.ranks})
                elif b.inside <= keep_rows:
                    ready.append(b)
                else:
                    wide.append(b)
            todo = _split(df, wide) if wide else []
        for part in chunks(ready, 4 * COLUMNS_PER_PASS):
            found.update(_resolve(df, part))
    return found


def value_extents(df: DataFrame, columns: list[str]) -> dict[str, tuple]:
    """(non-null count, min, max) of each column, one aggregate per forty columns."""
    out = {}
    for part in chunks(list(columns), 40):
        row = df.agg(*[f(as_double(df, c)) for c in part for f in (F.count, F.min, F.max)]).first()
        out.update({c: tuple(row[3 * i:3 * i + 3]) for i, c in enumerate(part)})
    return out


def exact_quantiles(df: DataFrame, columns: list[str], probabilities: list[float],
                    extents: dict | None = None,
                    keep_rows: int = KEEP_ROWS) -> dict[str, list[float | None]]:
    """Linearly interpolated quantiles of each column; None for a column without values."""
    extents = extents or value_extents(df, columns)
    positions = {c: [p * (extents[c][0] - 1) for p in probabilities]
                 for c in columns if extents[c][0]}
    ranks = {c: [r for x in xs for r in (math.floor(x), math.ceil(x))]
             for c, xs in positions.items()}
    found = order_statistics(df, ranks, extents, keep_rows)
    out: dict[str, list[float | None]] = {}
    for c in columns:
        if c not in positions:
            out[c] = [None] * len(probabilities)
            continue
        values = []
        for x in positions[c]:
            lo, hi = math.floor(x), math.ceil(x)
            a, b = found[c, lo], found[c, hi]
            values.append(a if lo == hi else a * (hi - x) + b * (x - lo))
        out[c] = values
    return out
