"""Profile and chart queries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from catalog.base import COLUMNS, WIDTHS, load, numerics, query, source, union
from tablewright.functions.columns import scrub_nonfinite
from tablewright.operators import charts
from tablewright.operators.profile import IDENTIFIER_NAMES, TARGET_NAMES, Profile
from tablewright.operators.rules import preview, triage
from tablewright.plans.pipeline import catalogue

PROFILED = "dirty_events"


def rounded(df, digits=6, columns=None):
    """Round double columns the operator leaves unrounded."""
    names = columns or [c for c, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(c, digits) for c in names})


def r(expr: str, digits: int) -> str:
    return f"round({expr}, {digits}) + 0.0"


def skew(c: str) -> str:
    return f"case when count({c}) > 2 then case when min({c}) = max({c}) then 0.0 else skewness({c}) end end"


def kurt(c: str) -> str:
    return f"case when count({c}) > 3 then case when min({c}) = max({c}) then 0.0 else kurtosis({c}) end end"


# B1-B4

def _metadata_sql(table):
    strings = [c for c, f in COLUMNS[table] if f == "string"]
    fixed = sum(WIDTHS.get(c, 8) for c, f in COLUMNS[table] if f != "string")
    size = " + ".join([f"coalesce(sum(strlen({c})), 0)" for c in strings] + [f"count(*) * {fixed}"])
    return (f"{source(table)} select count(*) as num_rows, cast({len(COLUMNS[table])} as bigint) as num_columns, "
            f"cast({size} as bigint) as data_bytes from t")


@query("table_metadata", _metadata_sql("lineitem"))
def _(spark, sf):
    return Profile(load(spark, sf, "lineitem")).metadata()


def _types_sql(table, target=None):
    parts = []
    for c, f in COLUMNS[table]:
        if c == target:
            continue
        if f == "string":
            kind = (f"(select case when count(distinct {c}) < 20 or count(distinct {c}) / count(*) < 0.1 "
                    f"then 'categorical' else 'text' end from t)")
        else:
            kind = "'" + {"numeric": "numerical"}.get(f, f) + "'"
        parts.append(f"select '{c}' as \"column\", {kind} as kind")
    return f"{source(table)} {union(parts)}"


@query("feature_types", _types_sql(PROFILED))
def _(spark, sf):
    return Profile(load(spark, sf, PROFILED)).feature_types()


@query("feature_types_documents", _types_sql("documents", "lang"))
def _(spark, sf):
    return Profile(load(spark, sf, "documents"), "lang").feature_types()


def _missing_sql(table):
    return f"{source(table)} " + union(
        f"select '{c}' as \"column\", round(avg(case when {c} is null then 1.0 else 0.0 end), 6) as null_fraction from t"
        for c, _ in COLUMNS[table])


@query("missing_fractions", _missing_sql(PROFILED))
def _(spark, sf):
    return rounded(Profile(load(spark, sf, PROFILED)).missing())


@query("high_missing_columns", f"select * from ({_missing_sql(PROFILED)}) m where null_fraction > 0.4")
def _(spark, sf):
    return rounded(Profile(load(spark, sf, PROFILED)).high_missing())


# B5-B7

TARGETS = ("l_linenumber", "l_quantity", "l_shipdate", "l_linestatus")


@query("target_problem_types", source("lineitem") + union(
    f" select '{c}' as target, case when {'true' if dict(COLUMNS['lineitem'])[c] != 'numeric' else 'false'} "
    f"or count(distinct {c}) < 15 then 'classification' else 'regression' end as target_type, "
    f"count(distinct {c}) as num_unique from t" for c in TARGETS))
def _(spark, sf):
    parts = [Profile(load(spark, sf, "lineitem"), c).target_analysis()
             .select(F.lit(c).alias("target"), "target_type", "num_unique") for c in TARGETS]
    return reduce(DataFrame.unionByName, parts)


@query("class_distribution", """
    select l_returnflag as class, count(*) as n,
      round(count(*) / cast((select count(*) from lineitem where l_returnflag is not null) as double), 6) as share
    from lineitem where l_returnflag is not null group by l_returnflag""")
def _(spark, sf):
    return rounded(Profile(load(spark, sf, "lineitem"), "l_returnflag").class_distribution())


@query("class_distribution_with_nulls", f"""
    {source(PROFILED)}, c as (select event_type as class, count(*) as n from t where event_type is not null
      group by event_type)
    select class, n, round(n / cast((select sum(n) from c) as double), 6) as share from c""")
def _(spark, sf):
    return rounded(Profile(load(spark, sf, PROFILED), "event_type").class_distribution())


@query("target_analysis_class", """
    select 'classification' as target_type, count(*) as num_unique,
      round(min(n) / cast(sum(n) as double), 6) as imbalance_ratio, cast(null as double) as mean,
      cast(null as double) as std, cast(null as double) as skewness
    from (select l_returnflag, count(*) as n from lineitem group by l_returnflag) c""")
def _(spark, sf):
    return rounded(Profile(load(spark, sf, "lineitem"), "l_returnflag").target_analysis())


@query("target_analysis_regression", """
    select 'regression' as target_type, count(distinct l_extendedprice) as num_unique,
      cast(null as double) as imbalance_ratio, round(avg(l_extendedprice), 6) as mean,
      round(stddev_samp(l_extendedprice), 6) as std, round(skewness(l_extendedprice), 6) as skewness
    from lineitem""")
def _(spark, sf):
    return rounded(Profile(load(spark, sf, "lineitem"), "l_extendedprice").target_analysis())


# B8, B9, B19

def _summary_sql(table, target=None):
    return f"{source(table)} " + union(
        f"select '{c}' as \"column\", {r(f'avg({c})', 4)} as mean, {r(f'stddev_samp({c})', 4)} as std, "
        f"{r(f'min({c})', 4)} as \"min\", {r(f'max({c})', 4)} as \"max\", {r(skew(c), 4)} as skewness, "
        f"{r(f'quantile_cont({c}, 0.5)', 4)} as median from t" for c in numerics(table, (target,)))


@query("numeric_summary", _summary_sql("lineitem", "l_extendedprice"))
def numeric_summary(spark, sf):
    return Profile(load(spark, sf, "lineitem"), "l_extendedprice").numeric_summary()


@query("numeric_summary_dirty", _summary_sql(PROFILED))
def _(spark, sf):
    return Profile(load(spark, sf, PROFILED)).numeric_summary()


@query("numeric_summary_extended", f"{source(PROFILED)} " + union(
    f"select '{c}' as \"column\", {r(f'avg({c})', 6)} as mean, {r(f'stddev_samp({c})', 6)} as std, "
    f"{r(f'min({c})', 6)} as \"min\", {r(f'max({c})', 6)} as \"max\", {r(f'max({c}) - min({c})', 6)} as \"range\", "
    f"{r(skew(c), 6)} as skewness, {r(kurt(c), 6)} as kurtosis, {r(f'quantile_cont({c}, 0.5)', 6)} as median from t"
    for c in numerics(PROFILED)))
def _(spark, sf):
    df = rounded(Profile(load(spark, sf, PROFILED)).extended_summary())
    return df.withColumns({c: F.col(c) + F.lit(0.0) for c, t in df.dtypes if t == "double"})


@query("describe_table", f"{source(PROFILED)} " + union(
    f"select '{c}' as \"column\", count({c}) as \"count\", {r(f'avg({c})', 6)} as mean, "
    f"{r(f'stddev_samp({c})', 6)} as std, {r(f'min({c})', 6)} as \"min\", "
    + ", ".join(f"{r(f'quantile_cont({c}, {q / 100})', 6)} as q{q}" for q in (25, 50, 75))
    + f", {r(f'max({c})', 6)} as \"max\" from t" for c in numerics(PROFILED)))
def _(spark, sf):
    return rounded(Profile(load(spark, sf, PROFILED)).describe())


@query("schema_listing", """
    select row_number() over () as position, column_name as "column",
      case column_type when 'BIGINT' then 'bigint' when 'INTEGER' then 'int' when 'DOUBLE' then 'double'
        when 'VARCHAR' then 'string' when 'TIMESTAMP' then 'timestamp_ntz' else column_type end as dtype
    from (describe select * from lineitem)""")
def _(spark, sf):
    return Profile(load(spark, sf, "lineitem")).schema()


# B10, B11, J5

def clean_corr(a, b):
    """DuckDB correlation with NULL for an undefined one."""
    return f"(select case when isnan(c) then null else c end from (select corr({a}, {b}) as c from t) k)"


def _matrix_sql(table, target=None):
    names = numerics(table, (target,))
    return f"{source(table)} " + union(
        f"select '{a}' as col, '{b}' as \"row\", {r(clean_corr(a, b), 2)} as val" for a in names for b in names)


@query("correlation_matrix", _matrix_sql("lineitem", "l_extendedprice"))
def _(spark, sf):
    return Profile(load(spark, sf, "lineitem"), "l_extendedprice").correlation_matrix()


@query("correlation_matrix_dirty", _matrix_sql(PROFILED))
def _(spark, sf):
    return Profile(load(spark, sf, PROFILED)).correlation_matrix()


def _high_sql(table):
    names = numerics(table)
    pairs = union(f"select '{a}' as f1, '{b}' as f2, abs({clean_corr(a, b)}) as c"
                  for i, a in enumerate(names) for b in names[i + 1:])
    return f"{source(table)} select f1, f2, round(c, 4) as val from ({pairs}) p where c > 0.8"


@query("high_correlation_pairs", _high_sql("planted"))
def _(spark, sf):
    return Profile(load(spark, sf, "planted"), "y_reg").high_correlation_pairs()


@query("high_correlation_pairs_dirty", _high_sql(PROFILED))
def _(spark, sf):
    return Profile(load(spark, sf, PROFILED)).high_correlation_pairs()


@query("correlation_bands", f"""select *, case when val > 0.7 then 'strong' when val > 0.3 then 'medium'
    when val < -0.3 then 'negative' else 'weak' end as band from ({_matrix_sql('planted')}) m""")
def _(spark, sf):
    return charts.correlation_bands(load(spark, sf, "planted"))


# B12-B14

@query("categorical_cardinality", f"{source(PROFILED)} " + union(
    f"select '{c}' as \"column\", count(distinct {c}) as num_unique from t"
    for c, f in COLUMNS[PROFILED] if f != "numeric" and c != "event_type"))
def _(spark, sf):
    return Profile(load(spark, sf, PROFILED), "event_type").cardinality()


@query("categorical_cardinality_documents", f"{source('documents')} " + union(
    f"select '{c}' as \"column\", count(distinct {c}) as num_unique from t"
    for c, f in COLUMNS["documents"] if f == "string"))
def _(spark, sf):
    return Profile(load(spark, sf, "documents")).cardinality()


def z_flag(c):
    return (f"abs(({c} - (select avg({c}) from t)) / nullif((select stddev_samp({c}) from t), 0)) > 2.5")


def z_rows(table, skip=()):
    """SQL rows (column, count, pct) before the zero counts are dropped."""
    return union(f"select '{c}' as \"column\", count(*) filter (where {z_flag(c)}) as \"count\", "
                 f"round(count(*) filter (where {z_flag(c)}) / cast(count({c}) as double), 4) as pct from t"
                 for c in numerics(table, skip))


@query("outlier_summary_zscore", f"{source(PROFILED)} select * from ({z_rows(PROFILED)}) z where \"count\" > 0")
def _(spark, sf):
    return Profile(load(spark, sf, PROFILED)).outlier_summary()


@query("outlier_samples", f"{source(PROFILED)} select * from (" + union(
    f"select cast(event_id as bigint) as event_id, '{c}' as \"column\", "
    f"row_number() over (order by event_id) as place from t where {z_flag(c)}"
    for c in numerics(PROFILED)) + ") s where place <= 20")
def _(spark, sf):
    return Profile(load(spark, sf, PROFILED), key="event_id").outlier_samples()


def fence_sql(c):
    q1, q3 = (f"(select quantile_cont({c}, {q}) from t)" for q in (0.25, 0.75))
    return f"{q1} - 1.5 * ({q3} - {q1})", f"{q3} + 1.5 * ({q3} - {q1})"


@query("outlier_summary_iqr", f"{source(PROFILED)} " + union(
    f"select '{c}' as \"column\", round(count(*) filter (where {c} < {fence_sql(c)[0]} or {c} > {fence_sql(c)[1]}) "
    f"/ cast(count({c}) as double), 6) as outlier_pct from t" for c in numerics(PROFILED)))
def _(spark, sf):
    return rounded(Profile(load(spark, sf, PROFILED)).iqr_outliers())


# B15, B16

def mi_sql(table, target):
    if target not in numerics(table):
        return "cast(0.4 as double)"
    rs = union(f"select {clean_corr(target, c)} as c" for c in numerics(table, (target,)))
    return f"(select least(coalesce(avg(abs(c)), 0.3), 1.0) from ({rs}) m)"


def risk_sql(table, target, classes):
    names = numerics(table)
    pairs = union(f"select {clean_corr(a, b)} as c" for i, a in enumerate(names) for b in names[i + 1:])
    corr = f"(select case when count(*) = count(c) then avg(abs(c)) else 0.0 end from ({pairs}) p)"
    noise = f"(select coalesce(sum(pct) filter (where \"count\" > 0) / greatest(count(*) filter (where \"count\" > 0), 1), 0.0) from ({z_rows(table, (target,))}) z)"
    share = (f"(select min(n) / cast(sum(n) as double) from (select count(*) as n from t where {target} is not null "
             f"group by {target}) c)")
    imbalance = f"case when {share} < 0.5 then 1.0 - 2.0 * {share} else 0.0 end" if classes else "cast(0 as double)"
    return f"""{source(table)}, parts as (select
        least({len(COLUMNS[table]) - 1} / cast((select count(*) from t) as double), 1.0) as ratio,
        {imbalance} as imbalance, 1.0 - {mi_sql(table, target)} as one_minus_mi, {corr} as mean_corr, {noise} as noise)
        select round(least(greatest(0.3 * ratio + 0.2 * imbalance + 0.2 * one_minus_mi + 0.2 * mean_corr
          + 0.1 * noise, 0.0), 1.0), 4) as score, round(ratio, 4) as d_n_ratio, round(imbalance, 4) as imbalance,
          round(one_minus_mi, 4) as one_minus_mi, round(mean_corr, 4) as mean_corr, round(noise, 4) as noise_proxy
        from parts"""


@query("mutual_information_proxy", f"{source('planted')} select round({mi_sql('planted', 'y_reg')}, 6) as y_reg, "
                                   f"cast(0.4 as double) as y_cls, cast(0.5 as double) as no_target")
def _(spark, sf):
    df = load(spark, sf, "planted")
    values = [Profile(df, t).mutual_information for t in ("y_reg", "y_cls", None)]
    return rounded(df.sparkSession.createDataFrame([tuple(values)], "y_reg double, y_cls double, no_target double"))


for _name, _table, _target, _classes in (
        ("overfitting_risk_class", "lineitem", "l_returnflag", True),
        ("overfitting_risk_regression", "lineitem", "l_extendedprice", False),
        ("overfitting_risk_dirty", "dirty_events", "event_type", True),
        ("overfitting_risk_planted", "planted", "y_reg", False)):
    def _risk(spark, sf, table=_table, target=_target):
        return Profile(load(spark, sf, table), target).overfitting_risk()
    query(_name, risk_sql(_table, _target, _classes))(_risk)


# B17, B18, K1

def scores_sql(table, rules):
    """SQL rows (column, position, score) of the target guess; needs CTE t."""
    last = len(COLUMNS[table]) - 1
    rows = union(
        f"select '{c}' as \"column\", {i} as position, '{f}' as family, count(distinct {c}) as nu, "
        f"count(*) as n, avg(case when {c} is null then 1.0 else 0.0 end) as missing, "
        + (f"stddev_samp({c})" if f == "numeric" else "cast(null as double)") + " as std from t"
        for i, (c, f) in enumerate(COLUMNS[table]))
    return f"""select "column", position,
        case when regexp_matches("column", '{TARGET_NAMES[rules]}') then 5.0 else 0.0 end
        - case when regexp_matches("column", '{IDENTIFIER_NAMES[rules]}') then 4.0 else 0.0 end
        + case when family = 'string' then case when nu <= 50 then 3.0 else -2.0 end
               when family in ('numeric', 'boolean') then case when nu <= 20 then 2.0 else 1.0 end else 0.0 end
        - case when std = 0 then 5.0 else 0.0 end
        + case when position in (0, {last}) then 1.0 else 0.0 end
        - 2.0 * missing - case when nu / n > 0.9 then 3.0 else 0.0 end as score
        from ({rows}) c where nu > 1 and missing <= 0.8"""


def _candidates_sql(table, rules):
    return f"""{source(table)}, s as ({scores_sql(table, rules)})
        select row_number() over (order by score desc, position) as place, "column", round(score, 6) as score,
          round(least(greatest(max(score) over () / 8, 0.0), 1.0), 6) as confidence from s"""


for _rules, _suffix in (("current", ""), ("v0", "_v0")):
    for _table in ("lineitem", "dirty_events"):
        def _guess(spark, sf, table=_table, rules=_rules):
            return rounded(Profile(load(spark, sf, table)).target_candidates(rules))
        query(f"target_candidates_{_table}{_suffix}", _candidates_sql(_table, _rules))(_guess)

TRIAGED = ("customer", "supplier", "part", "orders", "lineitem", "documents")


def _triage_part(table):
    best = f"(select \"column\" from ({scores_sql(table, 'current')}) s order by score desc, position limit 1)"
    top = f"least(greatest(coalesce((select max(score) from ({scores_sql(table, 'current')}) s), 0.0) / 8, 0.0), 1.0)"
    return (f"select * from ({source(table)} select '{table}' as dataset, (select count(*) from t) as num_rows, "
            f"cast({len(COLUMNS[table])} as bigint) as num_columns, {best} as suggested_target, {top} as confidence)")


@query("dataset_triage", f"""select dataset, num_rows, num_columns, suggested_target, round(confidence, 6) as confidence,
    case when confidence > 0.3 then 'supervised' else 'unsupervised' end as path,
    case when confidence > 0.3 then 'classification' else 'clustering' end as task_type,
    case when confidence > 0.5 then 'supervised' when num_columns > 20 and num_rows > 100 then 'unsupervised'
      else 'supervised' end as path_v0,
    case when confidence > 0.7 then 'High' else 'Medium' end as confidence_level
    from ({union(_triage_part(t) for t in TRIAGED)}) c""")
def _(spark, sf):
    return rounded(triage(catalogue({t: load(spark, sf, t) for t in TRIAGED})))


# B21

def _full_sql(table, target):
    null_s, null_d = "cast(null as varchar)", "cast(null as double)"

    def long(section, sql, names, metrics, label=null_s):
        return union(f"select '{section}' as section, {names} as \"column\", '{m}' as metric, "
                     f"cast(\"{m}\" as double) as value, {label} as label from ({sql}) x" for m in metrics)

    column = '"column"'
    parts = [
        long("metadata", _metadata_sql(table), null_s, ("num_rows", "num_columns", "data_bytes")),
        f"select 'feature_types', \"column\", 'kind', {null_d}, kind from ({_types_sql(table, target)}) x",
        long("missing", _missing_sql(table), column, ("null_fraction",)),
        long("numerical_summary", _summary_sql(table, target), column,
             ("mean", "std", "min", "max", "skewness", "median")),
        long("correlation_matrix", _matrix_sql(table, target), "concat(col, '~', \"row\")", ("val",)),
        long("correlation_summary", _high_sql(table), "concat(f1, '~', f2)", ("val",)),
        long("categorical_cardinality", f"{source(table)} " + union(
            f"select '{c}' as \"column\", count(distinct {c}) as num_unique from t"
            for c, f in COLUMNS[table] if f != "numeric" and c != target), column, ("num_unique",)),
        long("outlier_summary", f"{source(table)} select * from ({z_rows(table, (target,))}) z where \"count\" > 0",
             column, ("count", "pct")),
        long("overfitting_risk_index", risk_sql(table, target, False), null_s,
             ("score", "d_n_ratio", "imbalance", "one_minus_mi", "mean_corr", "noise_proxy")),
        long("target_analysis", f"{source(table)} select count(distinct {target}) as num_unique, "
             f"{null_d} as imbalance_ratio, avg({target}) as mean, stddev_samp({target}) as std, "
             f"skewness({target}) as skewness from t", f"'{target}'",
             ("num_unique", "imbalance_ratio", "mean", "std", "skewness"), "'regression'"),
    ]
    return f"select section, \"column\", metric, round(value, 6) as value, label from ({union(parts)}) f"


@query("full_profile", _full_sql("orders", "o_totalprice"))
def _(spark, sf):
    return rounded(Profile(load(spark, sf, "orders"), "o_totalprice").full())


# A4

@query("scrub_nonfinite", f"{source(PROFILED)} select cast(event_id as bigint) as event_id, round(value, 6) as value, "
                          f"round(half_null, 6) as half_null from t")
def _(spark, sf):
    return rounded(scrub_nonfinite(load(spark, sf, PROFILED)).select("event_id", "value", "half_null"))


# J1-J4

def bin_sql(c, low, high, bins=20):
    return f"cast(greatest(least(floor(({c} - {low}) / ({high} - {low}) * {bins}), {bins - 1}), 0) as int)"


def _histogram_sql(table, c):
    low, high = f"(select min({c}) from t)", f"(select max({c}) from t)"
    return f"""{source(table)}, b as (select {bin_sql(c, low, high)} as bin, count(*) as n from t
        where {c} is not null group by 1)
        select cast(i as int) as bin, round({low} + i * (({high} - {low}) / 20), 6) as low,
          round({low} + (i + 1) * (({high} - {low}) / 20), 6) as high, coalesce(n, 0) as n
        from range(20) g(i) left join b on b.bin = g.i"""


@query("histogram", _histogram_sql("lineitem", "l_extendedprice"))
def _(spark, sf):
    return rounded(charts.histogram(load(spark, sf, "lineitem"), "l_extendedprice"))


@query("histogram_dirty", _histogram_sql(PROFILED, "value"))
def _(spark, sf):
    return rounded(charts.histogram(load(spark, sf, PROFILED), "value"))


@query("scatter_points", f"{source(PROFILED)} select round(value, 6) as x, round(half_null, 6) as y from t")
def _(spark, sf):
    return rounded(charts.scatter_points(load(spark, sf, PROFILED), "value", "half_null"))


def _lo_hi(c):
    return f"(select min({c}) from t)", f"(select max({c}) from t)"


@query("scatter_density", f"""{source('lineitem')} select {bin_sql('l_quantity', *_lo_hi('l_quantity'))} as x_bin,
    {bin_sql('l_extendedprice', *_lo_hi('l_extendedprice'))} as y_bin, count(*) as n from t group by 1, 2""")
def _(spark, sf):
    return charts.scatter_density(load(spark, sf, "lineitem"), "l_quantity", "l_extendedprice")


@query("bar_counts", "select l_returnflag as label, count(*) as value from lineitem group by 1")
def _(spark, sf):
    return charts.bar(load(spark, sf, "lineitem"), "l_returnflag")


@query("bar_top_values", """select l_suppkey as label, round(sum(l_quantity), 4) as value from lineitem group by 1
    order by 2 desc, 1 limit 10""")
def _(spark, sf):
    return rounded(charts.bar(load(spark, sf, "lineitem"), "l_suppkey", "l_quantity", top=10), 4)


def _box_sql(table, names):
    rows = []
    for c in names:
        low, high = fence_sql(c)
        inside = f"{c} between {low} and {high}"
        quart = ", ".join(f"round(quantile_cont({c}, {q}), 6) as {n}" for q, n in
                          ((0.25, "q25"), (0.5, "median"), (0.75, "q75")))
        rows.append(f"select '{c}' as \"column\", min({c}) as \"min\", {quart}, max({c}) as \"max\", "
                    f"min({c}) filter (where {inside}) as whisker_low, max({c}) filter (where {inside}) as whisker_high, "
                    f"count({c}) filter (where not ({inside})) as outliers from t")
    inner = f"{source(table)} {union(rows)}"
    cols = "min q25 median q75 max whisker_low whisker_high".split()
    return ("select \"column\", " + ", ".join(f"round(\"{c}\", 6) as \"{c}\"" for c in cols)
            + f", outliers from ({inner}) b")


@query("box_summary", _box_sql(PROFILED, numerics(PROFILED)))
def _(spark, sf):
    return rounded(charts.box_summary(load(spark, sf, PROFILED)))


@query("box_summary_lineitem", _box_sql("lineitem", numerics("lineitem")))
def _(spark, sf):
    return rounded(charts.box_summary(load(spark, sf, "lineitem")))


# L1-L3

@query("preview_head", "select * from (select " + ", ".join(
    f"substring(cast({c} as varchar), 1, 15) as {c}" for c in ("o_orderkey", "o_custkey", "o_orderstatus",
                                                              "o_orderpriority"))
    + " from orders order by orders.o_orderkey limit 15) p")
def _(spark, sf):
    df = load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
    return preview(df, ["o_orderkey"])


@query("head_three", "select o_orderkey, o_custkey, o_totalprice from orders order by o_orderkey limit 3")
def _(spark, sf):
    return load(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice").orderBy("o_orderkey").limit(3)
