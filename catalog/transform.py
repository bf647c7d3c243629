"""Outlier treatment, feature derivation, preparation and source/sink queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import VIEWS, load, numerics, query, source, union
from catalog.profile import fence_sql, rounded, z_flag, z_rows
from tablewright.functions.session import shared_path
from tablewright.functions.tables import small_table
from tablewright.operators import features as X
from tablewright.operators import prep as P
from tablewright.operators.outliers import fit_treatment, treat_outliers
from tablewright.operators.profile import Profile
from tablewright.operators.search import fitness, generation_summary
from tablewright.sources.readers import read_table
from tablewright.sources.sinks import save_history, save_report

DIRTY = "dirty_events"
FLAGGED = ("value", "half_null")  # the columns of dirty_events with z-score outliers
KEPT = ["event_id", "user_id", "value", "half_null"]


def kept_sql(replaced=None):
    cells = {c: c for c in KEPT} | (replaced or {})
    return ", ".join(f"round({e}, 6) as {c}" if c in FLAGGED else f"cast({e} as bigint) as {c}"
                     for c, e in cells.items())


def kept(df):
    return rounded(df.select(*KEPT))


def treated(spark, sf, strategy, **options):
    return treat_outliers(load(spark, sf, DIRTY), strategy, key="event_id", **options)


# C

@query("outliers_remove", f"{source(DIRTY)} select {kept_sql()} from t where "
       + " and ".join(f"not coalesce({z_flag(c)}, false)" for c in numerics(DIRTY)))
def _(spark, sf):
    return kept(treated(spark, sf, "remove"))


def _capped(c):
    low, high = fence_sql(c)
    return f"case when {c} is not null then least(greatest({c}, {low}), {high}) end"


@query("outliers_cap", f"{source(DIRTY)} select {kept_sql({c: _capped(c) for c in FLAGGED})} from t")
def _(spark, sf):
    return kept(treated(spark, sf, "cap"))


@query("outliers_log", f"{source(DIRTY)} select {kept_sql()} from t")
def _(spark, sf):
    # Both flagged columns hold nulls, so neither is transformed.
    return kept(treated(spark, sf, "log"))


@query("outliers_log_whole_column", """with t as (select event_id, case when event_id % 97 = 0 then value * 20 + 1000
      else value end as v from events)
    select event_id, round(case when (select min(v) from t) >= 0 then ln(1 + v) else v end, 6) as v from t""")
def _(spark, sf):
    df = load(spark, sf, "events").select("event_id", F.expr(
        "case when event_id % 97 = 0 then value * 20 + 1000 else value end").alias("v"))
    return rounded(treat_outliers(df, "log", key="event_id"))


@query("outliers_flag", f"{source(DIRTY)} select {kept_sql()}, " + ", ".join(
    f"cast(coalesce({z_flag(c)}, false) as int) as is_outlier_{c}" for c in FLAGGED) + " from t")
def _(spark, sf):
    # A column without outliers has no flag column; none of its rows is one.
    df = treated(spark, sf, "flag")
    flags = [f"is_outlier_{c}" for c in FLAGGED]
    return rounded(df.select(*KEPT, *[c if c in df.columns else F.lit(0).alias(c) for c in flags]))


@query("outliers_keep", f"{source(DIRTY)} select {kept_sql()} from t")
def _(spark, sf):
    return kept(treated(spark, sf, "keep"))


@query("outlier_total", f"""{source(DIRTY)}, z as ({z_rows(DIRTY)})
    select cast(coalesce(sum("count"), 0) as bigint) as total, case when sum("count") > 0 then 'cap' else 'keep' end as strategy from z
    union all select cast(0 as bigint), 'keep' from (select count(*) from lineitem) l""")
def _(spark, sf):
    fitted = [fit_treatment(load(spark, sf, t), "cap") for t in (DIRTY, "lineitem")]
    return small_table(spark, [(f.total, f.strategy) for f in fitted], "total long, strategy string")


# D

PROPOSALS = [
    {"name": "ratio", "expr": "value / (user_id % 3)"},
    {"name": "log_value", "expr": "ln(value)"},
    {"name": "twice", "expr": "ratio * 2 + abs(half_null)"},
    {"name": "root", "expr": "sqrt(value)"},
    {"name": "broken", "expr": "no_such_column + 1"},
    {"name": "whole", "expr": "sum(value)"},
    {"name": "windowed", "expr": "sum(value) over ()"},
    {"name": "noise", "expr": "rand() * value"},
    {"name": "rows", "expr": "explode(sequence(1, 3))"},
    {"name": "sub", "expr": "(select max(value) from events)"},
    {"name": "mixed", "expr": "case when value > 50 then 1 else 0 end"},
]


@query("derived_columns", f"""{source(DIRTY)}, d as (select event_id, value, half_null,
      case when cast(user_id as bigint) % 3 <> 0 then value / (cast(user_id as bigint) % 3) end as ratio from t)
    select cast(event_id as bigint) as event_id, round(ratio, 6) as ratio,
      round(case when value > 0 then ln(value) end, 6) as log_value, round(ratio * 2 + abs(half_null), 6) as twice,
      round(case when value >= 0 then sqrt(value) end, 6) as root, case when value > 50 then 1 else 0 end as mixed from d""")
def _(spark, sf):
    df, _ = X.derive(load(spark, sf, DIRTY), PROPOSALS)
    return rounded(df.select("event_id", "ratio", "log_value", "twice", "root", "mixed"))


APPLIED = ("ratio", "log_value", "twice", "root", "mixed")


@query("derivation_report", f"""{source(DIRTY)}, d as (select value, half_null,
      case when cast(user_id as bigint) % 3 <> 0 then value / (cast(user_id as bigint) % 3) end as ratio from t),
    v as (select ratio, case when value > 0 then ln(value) end as log_value, ratio * 2 + abs(half_null) as twice,
      case when value >= 0 then sqrt(value) end as root, case when value > 50 then 1 else 0 end as mixed from d)
    """ + " union all ".join(f"select '{p['name']}' as name, true as applied, count({p['name']}) as n_values from v" if p["name"] in APPLIED
                             else f"select '{p['name']}', false, 0" for p in PROPOSALS))
def _(spark, sf):
    df, report = X.derive(load(spark, sf, DIRTY), PROPOSALS)
    names = [p["name"] for p in PROPOSALS if p["name"] in df.columns]
    counts = df.agg(*[F.count(n).alias(n) for n in names]).select(
        F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("name", "n"))
    return report.join(counts, "name", "left").select("name", "applied", F.coalesce("n", F.lit(0)).cast("long").alias("n_values"))


@query("arithmetic_features", """select o_orderkey, round(o_totalprice * o_custkey, 4) as product,
      round(o_totalprice / nullif(o_custkey % 5, 0), 6) as ratio, round(ln(1 + o_totalprice), 6) as log_price,
      o_custkey - o_orderkey as difference from orders""")
def _(spark, sf):
    df, _ = X.derive(load(spark, sf, "orders"), [
        {"name": "product", "expr": "o_totalprice * o_custkey"},
        {"name": "ratio", "expr": "o_totalprice / (o_custkey % 5)"},
        {"name": "log_price", "expr": "log1p(o_totalprice)"},
        {"name": "difference", "expr": "o_custkey - o_orderkey"}])
    return (df.select("o_orderkey", F.round("product", 4).alias("product"), F.round("ratio", 6).alias("ratio"),
                      F.round("log_price", 6).alias("log_price"), "difference"))


@query("column_statistic_features", f"""{source(DIRTY)} select cast(event_id as bigint) as event_id,
      round((value - (select avg(value) from t)) / (select stddev_samp(value) from t), 6) as z,
      round(value - (select quantile_cont(value, 0.5) from t), 6) as from_median,
      round(value / (select max(value) from t), 6) as of_max from t""")
def _(spark, sf):
    df, _ = X.derive(load(spark, sf, DIRTY), [
        {"name": "z", "expr": "(value - mean_value) / std_value"},
        {"name": "from_median", "expr": "value - median_value"},
        {"name": "of_max", "expr": "value / max_value"}],
        scalars={f"{s}_value": (s, "value") for s in ("mean", "std", "median", "max")})
    return rounded(df.select("event_id", "z", "from_median", "of_max"))


REQUESTED = ["num__o_custkey", " 'o_orderdate' ", "cat__o_orderstatus", "o_totalprice", "missing__column"]


@query("drop_features", "select o_orderkey, round(o_totalprice, 6) as o_totalprice, o_orderpriority from orders")
def _(spark, sf):
    return rounded(X.drop_features(load(spark, sf, "orders"), REQUESTED, "o_totalprice")[0])


@query("null_strategies", f"""{source(DIRTY)}, m as (select event_type, count(*) as n from t where event_type is not null
      group by 1 order by n desc, event_type limit 1)
    select cast(event_id as bigint) as event_id, round(coalesce(value, (select avg(value) from t)), 6) as value,
      coalesce(event_type, (select event_type from m)) as event_type, round(half_null, 6) as half_null
    from t where half_null is not null""")
def _(spark, sf):
    df = X.fill_nulls(load(spark, sf, DIRTY), {"value": "mean", "event_type": "mode", "half_null": "drop"})
    return rounded(df.select("event_id", "value", "event_type", "half_null"))


# E

def filled(c):
    return f"coalesce({c}, (select quantile_cont({c}, 0.5) from t))"


@query("impute_median", f"{source(DIRTY)} select cast(event_id as bigint) as event_id, round({filled('value')}, 6) as value, "
                        f"round({filled('half_null')}, 6) as half_null from t")
def _(spark, sf):
    return rounded(P.impute_median(load(spark, sf, DIRTY), ["value", "half_null"])
                   .select("event_id", "value", "half_null"))


@query("impute_mode", f"""{source(DIRTY)}, m as (select event_type, count(*) as n from t where event_type is not null
      group by 1 order by n desc, event_type limit 1)
    select cast(event_id as bigint) as event_id, coalesce(event_type, (select event_type from m)) as event_type from t""")
def _(spark, sf):
    return P.impute_mode(load(spark, sf, DIRTY), ["event_type"]).select("event_id", "event_type")


def scaled_sql(table, key, names):
    cells = ", ".join(f"{filled(c)} as {c}" for c in names)
    z = ", ".join(f"round(({c} - (select avg({c}) from f)) / (select case when min({c}) = max({c}) then 1 "
                  f"else stddev_pop({c}) end from f), 6) + 0.0 as num__{c}" for c in names)
    return f"{source(table)}, f as (select {key}, {cells} from t) select cast({key} as bigint) as {key}, {z} from f"


@query("standardise", scaled_sql(DIRTY, "event_id", ["value", "half_null", "const_col"]))
def _(spark, sf):
    names = ["value", "half_null", "const_col"]
    df = P.standardise(load(spark, sf, DIRTY), names)
    return df.select("event_id", *[(F.round(f"num__{c}", 6) + F.lit(0.0)).alias(f"num__{c}") for c in names])


PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")


@query("one_hot", """select o_orderkey, coalesce(cast(o_orderstatus = 'F' as int), 0) as "cat__o_orderstatus_F",
      coalesce(cast(o_orderstatus = 'O' as int), 0) as "cat__o_orderstatus_O",
      coalesce(cast(o_orderstatus = 'P' as int), 0) as "cat__o_orderstatus_P" from orders""")
def _(spark, sf):
    df = P.one_hot(load(spark, sf, "orders"), ["o_orderstatus"])
    return df.select("o_orderkey", *[c for c in df.columns if c.startswith("cat__")])


@query("one_hot_unseen", """select o_orderkey, cast(o_orderstatus = 'F' as int) as "cat__o_orderstatus_F",
      cast(o_orderstatus = 'O' as int) as "cat__o_orderstatus_O" from orders""")
def _(spark, sf):
    df = load(spark, sf, "orders")
    df = P.one_hot(df, ["o_orderstatus"], fit_on=df.where("o_orderstatus <> 'P'"))
    return df.select("o_orderkey", *[c for c in df.columns if c.startswith("cat__")])


def hash_sql(*keys):
    return f"cast('0x' || substr(md5(concat_ws('|', '42', {', '.join(keys)})), 1, 15) as bigint)"


def _order_sql(label):
    over = f"partition by {label}" if label else ""
    return f"""h as (select *, {hash_sql('o_orderkey')} as h from planted),
        o as (select *, rank() over ({over} order by h) - 1 as before, count(*) over ({over}) as total from h)"""


def split_sql(label=None):
    return (f"with planted as ({VIEWS['planted']}), {_order_sql(label)} select o_orderkey, "
            f"case when before >= total - ceil(0.2::double * total) then 'test' else 'train' end as split from o")


def folds_sql(label=None):
    passed = " + ".join(f"case when before >= (total // 5) * {i} + least({i}, total % 5) then 1 else 0 end"
                        for i in range(1, 5))
    return f"with planted as ({VIEWS['planted']}), {_order_sql(label)} select o_orderkey, {passed} as fold from o"


for _label, _kind in ((None, "random"), ("y_cls", "stratified")):
    def _split(spark, sf, label=_label):
        return P.split(load(spark, sf, "planted"), ["o_orderkey"], label).select("o_orderkey", "split")

    def _folds(spark, sf, label=_label):
        return P.folds(load(spark, sf, "planted"), ["o_orderkey"], label).select("o_orderkey", "fold")
    query(f"split_{_kind}", split_sql(_label))(_split)
    query(f"folds_{_kind}", folds_sql(_label))(_folds)


# A

@query("csv_round_trip", """select c_custkey, c_name, cast(c_nationkey as bigint) as c_nationkey, c_acctbal,
    c_mktsegment from customer""")
def _(spark, sf):
    path = shared_path(spark, "customer") + ".csv"
    load(spark, sf, "customer").write.csv(path, header=True)
    return read_table(spark, path)


@query("csv_missing_texts", f"""{source(DIRTY)} select cast(event_id as bigint) as event_id, event_type,
    round(value, 6) as value, round(half_null, 6) as half_null, is_third from t""")
def _(spark, sf):
    path = shared_path(spark, "dirty") + ".txt"
    load(spark, sf, DIRTY).select("event_id", "event_type", "value", "half_null", "is_third").write.csv(path, header=True)
    return rounded(read_table(spark, path))


@query("csv_line_breaks", "select doc_id, text, lang, source, n_chars from documents where text is not null and text not in ('', 'NA', 'null', 'None')")
def _(spark, sf):
    path = shared_path(spark, "documents") + ".csv"
    rows = load(spark, sf, "documents").where("text is not null and text not in ('', 'NA', 'null', 'None')")
    rows.write.csv(path, header=True, quote='"', escape='"')
    return read_table(spark, path)


@query("csv_given_schema", """select l_orderkey * 100000000000 + 1234567890123456789 as long_id, l_comment_free as note, l_quantity as l_quantity from
    (select *, case when l_linenumber = 3 then null else l_returnflag end as l_comment_free from lineitem) x""")
def _(spark, sf):
    path = shared_path(spark, "lineitem") + ".csv"
    note = F.when(F.col("l_linenumber") == 3, "NA").otherwise(F.col("l_returnflag"))
    load(spark, sf, "lineitem").select(note.alias("note"), F.col("l_quantity"), (F.col("l_orderkey") * 100000000000 + 1234567890123456789).alias("long_id")).write.csv(path, header=True)
    return read_table(spark, path, schema="long_id bigint, note string, l_quantity double")


@query("csv_long_ids", "select cast(l_orderkey as bigint) * 100000000000 + 1234567890123456789 as long_id, cast(l_linenumber as bigint) as l_linenumber from lineitem")
def _(spark, sf):
    path = shared_path(spark, "lineitem") + ".csv"
    load(spark, sf, "lineitem").select((F.col("l_orderkey").cast("bigint") * 100000000000 + 1234567890123456789).alias("long_id"), "l_linenumber").write.csv(path, header=True)
    return read_table(spark, path, multi_line=False)


@query("json_round_trip", "select o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderpriority from orders")
def _(spark, sf):
    path = shared_path(spark, "orders") + ".jsonl"
    load(spark, sf, "orders").drop("o_orderdate").write.json(path)
    return read_table(spark, path)


@query("parquet_source", "select s_suppkey, s_name, s_nationkey, s_acctbal from supplier")
def _(spark, sf):
    return read_table(spark, f"{sf}/supplier.parquet")


def fitness_sql():
    """CTE c: candidates with complexity and fitness at the default risk."""
    scale = 1 + 1.5 * 0.5
    return f"""with c0 as ({VIEWS['candidates']}), c1 as (select *,
        0.4::double * (n_selected / cast(n_features as double)) + 0.6::double * case
          when model in ('RandomForest', 'GradientBoosting') then n_estimators / 250.0::double * 0.5 +
            greatest(2, coalesce(max_depth, 20)) / 20.0::double * 0.5
          when model = 'DecisionTree' then greatest(2, coalesce(max_depth, 20)) / 20.0::double else 0 end as complexity
        from c0), c as (select *, mu - {0.05 * scale} * complexity - {0.15 * scale} * sigma - {0.10 * scale} * gap
        as fitness from c1)"""


@query("search_history_sink", f"""{fitness_sql()}, f as (select gen, first(model order by fitness desc, cand_id) as best_model,
      first(n_selected order by fitness desc, cand_id) as best_n_selected, max(fitness) as b, avg(fitness) as a from c group by gen)
    select cast(gen as bigint) as gen, round(b, 4) as best_fitness, round(a, 4) as avg_fitness, best_model,
      cast(best_n_selected as bigint) as best_n_selected from f""")
def _(spark, sf):
    history = generation_summary(fitness(load(spark, sf, "candidates")))
    return read_table(spark, save_history(history, shared_path(spark, "reports"), "run"), multi_line=False)


REPORT_SQL = """with p as (select p_brand as dataset, max(p_size) / 100 as ori, max(p_retailprice) / 2500 as mu,
      min(p_retailprice) / 3000 as fitness, min(p_size) / 400 as gap, min(p_type) as model from part group by p_brand)
    select dataset, printf('%.3f', ori) as ori, printf('%.4f', mu) as best_mu_cv,
      printf('%.4f', fitness) as fitness, printf('%.4f', gap) as gap, model from p"""


@query("benchmark_report_sink", REPORT_SQL)
def _(spark, sf):
    results = load(spark, sf, "part").groupBy(F.col("p_brand").alias("dataset")).agg(
        (F.max("p_size") / 100).alias("ori"), (F.max("p_retailprice") / 2500).alias("mu"),
        (F.min("p_retailprice") / 3000).alias("fitness"), (F.min("p_size") / 400).alias("gap"),
        F.min("p_type").alias("model"))
    path = shared_path(spark, "report")
    save_report(results, path)
    return spark.read.parquet(path)
