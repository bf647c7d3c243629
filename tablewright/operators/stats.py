"""Column and pair statistics shared by the profile sections.

First pass: counts, sums, extremes, string sizes. Second pass: powers of the values
centred on the first pass's mean, and their cross products. Both are plain sums, so
they stay inside generated code and combine before the shuffle.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tablewright.functions.columns import as_double, chunks, families, ref

SUMS_PER_PASS = 32
GRAM_FROM_COLUMNS = 24
DISTINCT_COLUMNS = 64
# Types whose values one 64-bit hash tells apart without fail.
ONE_TO_ONE = frozenset("boolean byte short integer long float double date timestamp timestamp_ntz".split())


@dataclass
class ColumnStats:
    name: str
    family: str
    rows: int
    n: int
    octets: int | None = None
    mean: float | None = None
    low: float | None = None
    high: float | None = None
    m2: float | None = None
    m3: float | None = None
    m4: float | None = None

    @property
    def null_fraction(self) -> float | None:
        return (self.rows - self.n) / self.rows if self.rows else None

    @property
    def constant(self) -> bool:
        return self.low == self.high

    @property
    def std(self) -> float | None:
        """Sample standard deviation."""
        if self.n < 2:
            return None
        return 0.0 if self.constant else math.sqrt(self.m2 / (self.n - 1))

    @property
    def std_pop(self) -> float | None:
        if not self.n:
            return None
        return 0.0 if self.constant else math.sqrt(self.m2 / self.n)

    @property
    def skewness(self) -> float | None:
        """Bias-corrected skewness; 0 for a constant column."""
        n = self.n
        if n < 3:
            return None
        if self.constant:
            return 0.0
        g1 = (self.m3 / n) / (self.m2 / n) ** 1.5
        return g1 * math.sqrt(n * (n - 1)) / (n - 2)

    @property
    def kurtosis(self) -> float | None:
        """Bias-corrected excess kurtosis; 0 for a constant column."""
        n = self.n
        if n < 4:
            return None
        if self.constant:
            return 0.0
        g2 = (self.m4 / n) / (self.m2 / n) ** 2 - 3
        return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6)


def basic_stats(df: DataFrame) -> dict[str, ColumnStats]:
    """Counts of every column; mean and extremes of numeric ones; octets of strings."""
    kinds = families(df)
    out: dict[str, ColumnStats] = {}
    for part in chunks(list(kinds), 16):
        wanted = [F.count("*")]
        for c in part:
            if kinds[c] == "numeric":
                x = as_double(df, c)
                wanted += [F.count(x), F.avg(x), F.min(x), F.max(x)]
            elif kinds[c] == "string":
                wanted += [F.count(ref(c)), F.sum(F.octet_length(ref(c)))]
            else:
                wanted.append(F.count(ref(c)))
        row = list(df.agg(*[w.alias(f"a{i}") for i, w in enumerate(wanted)]).first())
        rows = row.pop(0)
        for c in part:
            s = ColumnStats(c, kinds[c], rows, row.pop(0))
            if kinds[c] == "numeric":
                s.mean, s.low, s.high = row.pop(0), row.pop(0), row.pop(0)
            elif kinds[c] == "string":
                s.octets = row.pop(0) or 0
            out[c] = s
    return out


def _centred(df: DataFrame, stats: dict[str, ColumnStats], columns: list[str]) -> DataFrame:
    return df.select(*[(as_double(df, c) - F.lit(stats[c].mean)).alias(f"d{i}")
                       for i, c in enumerate(columns)])


def add_moments(df: DataFrame, stats: dict[str, ColumnStats], columns: list[str]) -> None:
    """Fill the centred power sums of numeric columns."""
    live = [c for c in columns if stats[c].n and not stats[c].constant]
    for part in chunks(live, SUMS_PER_PASS // 3):
        sums = []
        for i in range(len(part)):
            d = F.col(f"d{i}")
            sums += [F.sum(d * d), F.sum(d * d * d), F.sum(d * d * d * d)]
        row = _centred(df, stats, part).agg(*sums).first()
        for i, c in enumerate(part):
            stats[c].m2, stats[c].m3, stats[c].m4 = row[3 * i:3 * i + 3]


def _correlation(n, sa, sb, saa, sbb, sab) -> float | None:
    if not n or n < 2:
        return None
    va, vb = saa - sa * sa / n, sbb - sb * sb / n
    if va <= 0 or vb <= 0:
        return None
    return max(-1.0, min(1.0, (sab - sa * sb / n) / math.sqrt(va * vb)))


def _correlations_by_sums(df, stats, columns, pairs) -> dict[tuple[str, str], float | None]:
    """Aggregate expressions per pair; one cross product where neither side has nulls."""
    place = {c: i for i, c in enumerate(columns)}
    centred = _centred(df, stats, columns)
    jobs = []  # (pair, expressions)
    for a, b in pairs:
        x, y = F.col(f"d{place[a]}"), F.col(f"d{place[b]}")
        both = x * y
        if stats[a].n == stats[a].rows and stats[b].n == stats[b].rows:
            jobs.append(((a, b), [F.sum(both)]))
        else:
            xm, ym = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
            jobs.append(((a, b), [F.count(both), F.sum(xm), F.sum(ym),
                                  F.sum(xm * xm), F.sum(ym * ym), F.sum(both)]))
    out = {}
    batch, width = [], 0
    for job in jobs + [None]:
        if batch and (job is None or width + len(job[1]) > SUMS_PER_PASS):
            row = list(centred.agg(*[e.alias(f"a{i}") for i, e in
                                     enumerate(e for _, es in batch for e in es)]).first())
            for (a, b), es in batch:
                got = [row.pop(0) for _ in es]
                if len(got) == 1:
                    got = [stats[a].n, 0.0, 0.0, stats[a].m2, stats[b].m2, got[0]]
                out[a, b] = _correlation(*got)
            batch, width = [], 0
        if job:
            batch.append(job)
            width += len(job[1])
    return out


def _correlations_by_gram(df, stats, columns, pairs) -> dict[tuple[str, str], float | None]:
    """Wide tables: masked Gram matrices per task, summed by (i, j) on the cluster."""
    size = len(columns)

    def gram(batches):
        total = np.zeros((4, size, size))
        for pdf in batches:
            raw = pdf.to_numpy(dtype="float64", na_value=np.nan)
            mask = (~np.isnan(raw)).astype("float64")
            x = np.where(mask > 0, raw, 0.0)
            total += np.stack([mask.T @ mask, x.T @ mask, (x * x).T @ mask, x.T @ x])
        i, j = np.indices((size, size))
        yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "n": total[0].ravel(),
                            "s": total[1].ravel(), "q": total[2].ravel(), "p": total[3].ravel()})

    summed = (_centred(df, stats, columns)
              .mapInPandas(gram, "i int, j int, n double, s double, q double, p double")
              .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in "nsqp"]))
    cells = {(r["i"], r["j"]): r for r in summed.collect()}  # columns squared, no row data
    place = {c: i for i, c in enumerate(columns)}
    out = {}
    for a, b in pairs:
        ab, ba = cells[place[a], place[b]], cells[place[b], place[a]]
        out[a, b] = _correlation(ab["n"], ab["s"], ba["s"], ab["q"], ba["q"], ab["p"])
    return out


def pair_correlations(df: DataFrame, stats: dict[str, ColumnStats], columns: list[str],
                      gram_from: int = GRAM_FROM_COLUMNS) -> dict[tuple[str, str], float | None]:
    """Pearson r with pairwise null deletion for i < j; None where it is undefined."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    out: dict[tuple[str, str], float | None] = {p: None for p in pairs}
    live = [c for c in columns if stats[c].n and not stats[c].constant]
    live_pairs = [(a, b) for i, a in enumerate(live) for b in live[i + 1:]]
    if live_pairs:
        solve = _correlations_by_gram if len(live) >= gram_from else _correlations_by_sums
        out.update(solve(df, stats, live, live_pairs))
    return out


def distinct_counts(df: DataFrame, columns: list[str], approx: bool = False) -> dict[str, int]:
    """Distinct non-null values per column, exact unless `approx`.

    A row gives (column, hash, hash) for each value; these are combined in each task, then counted by hash, so the only
    shuffle moves 20 bytes for a column's distinct values in a task. One hash of 64 bits maps whole numbers, doubles, dates and times one
    to one; other types get a second one with another seed.
    """
    kinds = families(df)
    out = {}
    for part in chunks(list(columns), DISTINCT_COLUMNS):
        values = {c: as_double(df, c) if kinds[c] == "numeric" and df.schema[c].dataType.typeName() in ("double", "float") else ref(c) for c in part}
        if approx:
            out.update(zip(part, df.agg(*[F.approx_count_distinct(v).alias(f"a{i}") for i, v in enumerate(values.values())]).first()))
            continue
        marks = []
        for i, (c, value) in enumerate(values.items()):
            exact = df.schema[c].dataType.typeName() in ONE_TO_ONE
            second = F.lit(0).cast("long") if exact else F.xxhash64(F.lit(1), value)
            marks.append(F.when(value.isNotNull(), F.struct(F.lit(i).alias("at"), F.xxhash64(value).alias("h"), second.alias("g"))))
        seen = df.select(F.explode(F.array(*marks)).alias("m")).filter("m is not null").select("m.*").distinct()
        counts = {r["at"]: r["count"] for r in seen.groupBy("at").count().collect()}
        out.update({c: counts.get(i, 0) for i, c in enumerate(part)})
    return out
