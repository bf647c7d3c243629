"""Outlier treatment: fit the bounds once, then apply row-wise expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, functions as F

from tablewright.functions.columns import as_double
from tablewright.operators.profile import Z_LIMIT, Profile, fences

STRATEGIES = ("remove", "cap", "log", "flag", "keep")


@dataclass
class Treatment:
    """A fitted strategy; `apply` is a projection or filter, also on a stream."""
    strategy: str
    columns: list[str]
    total: int = 0
    moments: dict[str, tuple[float, float]] = field(default_factory=dict)
    bounds: dict[str, tuple[float, float]] = field(default_factory=dict)
    loggable: list[str] = field(default_factory=list)
    key: list[str] = field(default_factory=list)

    def _far(self, df: DataFrame, column: str):
        mean, std = self.moments[column]
        z = F.abs(as_double(df, column) - F.lit(mean)) / F.lit(std)
        return F.coalesce(z > F.lit(Z_LIMIT), F.lit(False))

    def apply(self, df: DataFrame) -> DataFrame:
        if self.strategy == "remove" and self.columns:
            for c in self.columns:
                df = df.where(~self._far(df, c))
        elif self.strategy == "cap":
            capped = {}
            for c in self.columns:
                low, high = self.bounds[c]
                x = as_double(df, c)
                capped[c] = F.when(x.isNotNull(), F.least(F.greatest(x, F.lit(low)), F.lit(high)))
            return df.withColumns(capped) if capped else df
        elif self.strategy == "log" and self.loggable:
            return df.withColumns({c: F.log1p(as_double(df, c)) for c in self.loggable})
        elif self.strategy == "flag" and self.columns:
            return df.withColumns({f"is_outlier_{c}": self._far(df, c).cast("int")
                                   for c in self.columns})
        return df


def fit_treatment(df: DataFrame | Profile, strategy: str = "cap", target: str | None = None,
                  key=None) -> Treatment:
    """Bounds for the columns that hold z-score outliers; `keep` when none does."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}, expected one of {STRATEGIES}")
    profile = df if isinstance(df, Profile) else Profile(df, target, key)
    flagged = list(profile.outliers)
    if not flagged:
        return Treatment("keep", [])
    out = Treatment(strategy, flagged, sum(n for n, _ in profile.outliers.values()),
                    key=profile.key)
    out.moments = {c: (profile.stats[c].mean, profile.stats[c].std) for c in flagged}
    if strategy == "cap":
        out.bounds = {c: fences(profile.quartiles[c]) for c in flagged}
    elif strategy == "log":
        out.loggable = [c for c in flagged
                        if profile.stats[c].n == profile.rows and profile.stats[c].low >= 0]
    return out


def treat_outliers(df: DataFrame, strategy: str = "cap", target: str | None = None, key=None) -> DataFrame:
    """Fit on the table and apply to it."""
    profile = Profile(df, target, key)
    return fit_treatment(profile, strategy).apply(profile.df)
