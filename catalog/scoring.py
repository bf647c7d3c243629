"""Metric, search-table and rule queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import VIEWS, load, query, view
from catalog.profile import rounded
from catalog.transform import fitness_sql
from tablewright.operators import metrics as M
from tablewright.operators import rules as R
from tablewright.operators import search as H

# F


def macro_sql(table, by=""):
    """SQL of accuracy and macro means over a table with label and pred."""
    group = f"{by}, " if by else ""
    same = f" and l.{by} = x.{by}" if by else ""
    return f"""classes as (select distinct {group} label as class from {table} union select distinct {group} pred from {table}),
      per as (select {'x.' + by + ',' if by else ''} class,
        (select count(*) from {table} l where l.label = class and l.pred = class{same}) as hits,
        (select count(*) from {table} l where l.label = class{same}) as support,
        (select count(*) from {table} l where l.pred = class{same}) as predicted from classes x),
      s as (select *, coalesce(hits / nullif(cast(predicted as double), 0), 0) as p,
        coalesce(hits / nullif(cast(support as double), 0), 0) as r,
        coalesce(2 * hits / nullif(cast(predicted + support as double), 0), 0) as f from per)"""


MACRO_COLUMNS = """round(sum(hits) / cast(sum(support) as double), 4) as accuracy, round(avg(f), 4) as f1_macro,
    round(avg(p), 4) as precision_macro, round(avg(r), 4) as recall_macro"""


@query("classification_metrics", f"{view('preds')}, {macro_sql('preds')} select {MACRO_COLUMNS} from s")
def _(spark, sf):
    return M.classification_metrics(load(spark, sf, "preds"))


@query("classification_metrics_multiclass", f"{view('preds3')}, {macro_sql('preds3')} select {MACRO_COLUMNS} from s")
def _(spark, sf):
    return M.classification_metrics(load(spark, sf, "preds3"))


@query("class_scores", f"""{view('preds3')}, {macro_sql('preds3')} select class, support, predicted, hits,
    round(p, 6) as "precision", round(r, 6) as recall, round(f, 6) as f1 from s""")
def _(spark, sf):
    return rounded(M.class_scores(load(spark, sf, "preds3")))


@query("confusion_matrix", f"{view('preds3')} select label, pred, count(*) as n from preds3 group by label, pred")
def _(spark, sf):
    return M.confusion(load(spark, sf, "preds3"))


def regression_sql(group=""):
    return f"""round(avg((y - p) * (y - p)), 4) as mse, round(sqrt(round(avg((y - p) * (y - p)), 4)), 4) as rmse,
      round(avg(abs(y - p)), 4) as mae, round(1 - avg((y - p) * (y - p)) / var_pop(y), 4) as r2"""


@query("regression_metrics", f"{view('reg_preds')} select {regression_sql()} from reg_preds")
def _(spark, sf):
    return M.regression_metrics(load(spark, sf, "reg_preds"), "y", "p")


@query("grouped_metrics", f"""{view('reg_preds')} select 'shifted' as model, split, {regression_sql()} from reg_preds group by split
    union all select 'exact', split, 0, 0, 0, 1 from reg_preds group by split""")
def _(spark, sf):
    base = load(spark, sf, "reg_preds")
    both = base.withColumn("model", F.lit("shifted")).unionByName(
        base.withColumns({"model": F.lit("exact"), "p": F.col("y")}))
    return M.regression_metrics(both, "y", "p", by=("model", "split"))


@query("grouped_class_metrics", f"""with g as (select *, case when l_linenumber % 2 = 0 then 'test' else 'train' end as split
      from ({VIEWS['preds3']}) x), {macro_sql('g', 'split')} select split, {MACRO_COLUMNS} from s group by split""")
def _(spark, sf):
    df = load(spark, sf, "preds3").withColumn(
        "split", F.expr("case when l_linenumber % 2 = 0 then 'test' else 'train' end"))
    return M.classification_metrics(df, by=("split",))


@query("overfitting_gap_regression", f"""{view('reg_preds')}, m as (select l_returnflag as model, l.split,
      round(sqrt(round(avg((y - p) * (y - p)), 4)), 4) as rmse from reg_preds l join
      (select distinct l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag from lineitem) k
      using (l_orderkey, l_linenumber, l_partkey, l_suppkey) group by 1, 2)
    select model, round(max(rmse) filter (where split = 'test') - max(rmse) filter (where split = 'train'), 4)
      as overfitting_gap from m group by model""")
def _(spark, sf):
    keys = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    flags = load(spark, sf, "lineitem").select(*keys, F.col("l_returnflag").alias("model")).distinct()
    table = M.regression_metrics(load(spark, sf, "reg_preds").join(flags, keys), "y", "p", by=("model", "split"))
    return M.overfitting_gap(table, "regression")


@query("overfitting_gap_class", f"""with g as (select 'flags' as model, l_orderkey % 5 = 0 as held, label = pred as hit
      from ({VIEWS['preds3']}) x)
    select model, round(round(avg(cast(hit as int)) filter (where not held), 4)
      - round(avg(cast(hit as int)) filter (where held), 4), 4) as overfitting_gap from g group by model""")
def _(spark, sf):
    df = load(spark, sf, "preds3").withColumns({
        "model": F.lit("flags"), "split": F.expr("case when l_orderkey % 5 = 0 then 'test' else 'train' end")})
    return M.overfitting_gap(M.classification_metrics(df, by=("model", "split")), "classification")


@query("primary_scores", f"""{view('reg_preds')} select 'shifted' as model,
    round(1 - avg((y - p) * (y - p)) filter (where split = 'train') / var_pop(y) filter (where split = 'train'), 4) as train_score,
    round(1 - avg((y - p) * (y - p)) filter (where split = 'test') / var_pop(y) filter (where split = 'test'), 4) as test_score
    from reg_preds""")
def _(spark, sf):
    df = load(spark, sf, "reg_preds").withColumn("model", F.lit("shifted"))
    return M.primary_scores(M.regression_metrics(df, "y", "p", by=("model", "split")), "regression")


# H1-H6, H8-H10 on prediction and candidate tables

@query("cross_validated_score", f"""{view('preds3')}, f as (select l_suppkey % 5 as fold, avg(cast(label = pred as int)) as score
      from preds3 group by 1) select 'flags' as model, round(avg(score), 6) as mu, round(stddev_pop(score), 6) as sigma from f""")
def _(spark, sf):
    df = load(spark, sf, "preds3").withColumns({"model": F.lit("flags"), "fold": F.expr("l_suppkey % 5")})
    return rounded(H.cross_validated(df, "classification"))


@query("cross_validated_score_regression", f"""{view('reg_preds')}, f as (select l_suppkey % 5 as fold,
      1 - avg((y - p) * (y - p)) / var_pop(y) as score from reg_preds group by 1)
    select 'shifted' as model, round(avg(score), 6) as mu, round(stddev_pop(score), 6) as sigma from f""")
def _(spark, sf):
    df = load(spark, sf, "reg_preds").select(
        F.lit("shifted").alias("model"), F.expr("l_suppkey % 5").alias("fold"), F.col("y").alias("label"),
        F.col("p").alias("pred"))
    return rounded(H.cross_validated(df, "regression"))


@query("generalisation_gap", f"""with r as ({VIEWS['runs']}) select run_id,
    round(greatest(0, round(train_score, 4) - test_score), 6) as gap from r""")
def _(spark, sf):
    gap = H.generalisation_gap(F.col("train_score"), F.col("test_score"))
    return load(spark, sf, "runs").select("run_id", F.round(gap, 6).alias("gap"))


@query("complexity_penalty", f"{fitness_sql()} select cand_id, round(complexity, 10) as complexity from c")
def _(spark, sf):
    df = load(spark, sf, "candidates")
    return df.select("cand_id", F.round(H.complexity(df), 10).alias("complexity"))


@query("risk_scaled_fitness", f"{fitness_sql()} select cand_id, round(fitness, 10) as fitness from c")
def _(spark, sf):
    return H.fitness(load(spark, sf, "candidates")).select("cand_id", F.round("fitness", 10).alias("fitness"))


@query("failed_candidates", f"""{fitness_sql()} select cand_id, round(case when n_selected = 1 then -1.0::double
    else fitness end, 10) as fitness from c""")
def _(spark, sf):
    df = load(spark, sf, "candidates").withColumn("mu", F.when(F.col("n_selected") > 1, F.col("mu")))
    return H.fitness(df).select("cand_id", F.round("fitness", 10).alias("fitness"))


@query("fitness_v0", f"""with c as ({VIEWS['candidates']}) select cand_id, round(case when gen = 5 then 0.0::double else
    mu + 0.1::double * (1 - n_selected / cast(n_features as double)) end, 6) as fitness from c""")
def _(spark, sf):
    df = load(spark, sf, "candidates").withColumn("score", F.when(F.col("gen") < 5, F.col("mu")))
    return H.fitness_v0(df).select("cand_id", F.round("fitness", 6).alias("fitness"))


GENERATIONS_SQL = f"""{fitness_sql()} select gen, round(max(fitness), 4) as best_fitness, round(avg(fitness), 4) as avg_fitness,
    first(model order by fitness desc, cand_id) as best_model,
    first(n_selected order by fitness desc, cand_id) as best_n_selected from c group by gen"""


@query("generation_summary", GENERATIONS_SQL)
def _(spark, sf):
    return H.generation_summary(H.fitness(load(spark, sf, "candidates")))


@query("best_candidate", f"""{fitness_sql()} select cand_id, model, round(fitness, 6) as fitness from c
    order by c.fitness desc, cand_id limit 1""")
def _(spark, sf):
    return rounded(H.best_candidate(H.fitness(load(spark, sf, "candidates"))))


@query("search_plateaus", f"""{fitness_sql()}, h as (select model, gen, round(max(fitness), 4) as best_fitness from c group by 1, 2)
    select model, gen, best_fitness, coalesce(abs(best_fitness - lag(best_fitness) over (partition by model order by gen))
      < 0.0001 and gen > 3, false) as plateau from h""")
def _(spark, sf):
    history = H.generation_summary(H.fitness(load(spark, sf, "candidates")), by=("model", "gen"), keep=("n_selected",))
    return H.plateaus(history.select("model", "gen", "best_fitness"), "model")


@query("search_run_summary", f"""{fitness_sql()}, h as (select n_features as run, gen, round(max(fitness), 4) as best_fitness,
      first(model order by fitness desc, cand_id) as best_model from c group by 1, 2)
    select run, count(*) as generations, round(max_by(best_fitness, gen), 4) as best_final_fitness,
      max_by(best_model, gen) as top_model from h group by run""")
def _(spark, sf):
    candidates = H.fitness(load(spark, sf, "candidates")).withColumnRenamed("n_features", "run")
    return H.run_summary(H.generation_summary(candidates, by=("run", "gen")))


# K

@query("review_verdicts", f"""with r as ({VIEWS['runs']}), i as ({VIEWS['run_importances']}),
    m as (select run_id, max(importance) as max_importance,
      first(feature order by importance desc, feature) as top_feature from i group by run_id),
    j as (select r.*, coalesce(max_importance, 0) as mi, top_feature, train_score - test_score > 0.10 as overfit,
      coalesce(max_importance, 0) > 0.50 as dominated, test_score < 0.85 as under, test_score >= 0.999 as leak
      from r left join m using (run_id)),
    v as (select *, not (overfit or dominated or under or leak) or iteration >= 3 as done from j)
    select run_id, overfit, dominated, under, leak, case when done then 'satisfied' else 'retry' end as status,
      case when not done then concat_ws(' ',
        case when overfit then concat('OVERFITTING DETECTED (Train ', printf('%.3f', train_score), ' vs Test ', printf('%.3f', test_score), ').') end,
        case when dominated then concat('FEATURE DOMINANCE DETECTED (''', top_feature, ''' contributes ', printf('%.3f', mi), '!).') end,
        case when under and not overfit then concat('UNDERPERFORMING (Test score ', printf('%.3f', test_score), ' < 0.85 Target).') end,
        case when leak then concat('DATA LEAKAGE DETECTED (Test score ', printf('%.3f', test_score), ' >= 0.999 is suspiciously perfect. A feature is likely leaking the target variable).') end
      ) end as issues from v""")
def _(spark, sf):
    verdict = R.review(load(spark, sf, "runs"), load(spark, sf, "run_importances"), F.col("iteration"))
    return verdict.select("run_id", "overfit", "dominated", "under", "leak", "status", "issues")


@query("best_run", f"""with r as ({VIEWS['runs']}) select run_id, round(test_score, 6) as test_score from r
    order by r.test_score desc, run_id limit 1""")
def _(spark, sf):
    return rounded(R.best_run(load(spark, sf, "runs")).select("run_id", "test_score"))


@query("trace_rollup", f"""with s as (select *, case when status in ('success', 'error')
      then round((finished_at - started_at) * 1000, 1) else 0.0::double end as duration_ms from ({VIEWS['steps']}) x)
    select agent_name, count(*) as total_steps,
      round(coalesce(sum(duration_ms) filter (where status <> 'pending'), 0), 4) as total_duration_ms,
      count(*) filter (where status = 'pending') as n_pending, count(*) filter (where status = 'running') as n_running,
      count(*) filter (where status = 'success') as n_success, count(*) filter (where status = 'error') as n_error
    from s group by agent_name""")
def _(spark, sf):
    return rounded(R.trace_rollup(R.trace_steps(load(spark, sf, "steps"))), 4)


@query("trace_steps", f"""select event_id, substring(input_summary, 1, 500) as input_summary,
    substring(output_summary, 1, 500) as output_summary, case when status in ('success', 'error')
      then round((finished_at - started_at) * 1000, 1) else 0.0::double end as duration_ms from ({VIEWS['steps']}) x""")
def _(spark, sf):
    return R.trace_steps(load(spark, sf, "steps")).select("event_id", "input_summary", "output_summary", "duration_ms")


def replies_sql(strict):
    bad = f"{'true' if strict else 'false'} and len(missing) > 0"
    return f"""{view('replies')}, c as (select event_id, trim(replace(replace(reply, '```json', ''), '```', ''), ' \n' || chr(10)) as txt from replies),
      p as (select event_id, txt, json_valid(txt) as valid, case when json_valid(txt) then json_type(txt) end as kind from c),
      q as (select *, case when kind = 'OBJECT' then list_filter(['k', 'a'], lambda x: not list_contains(json_keys(txt), x)) end as missing from p)
      select event_id, case when not valid then 'invalid_json' when kind <> 'OBJECT' then 'not_object'
          when {bad} then 'missing_required' else 'ok' end as status, cast(missing as varchar[]) as missing,
        case when kind = 'OBJECT' and not ({bad}) then coalesce(json_extract_string(txt, '$.a'), '7') end as a,
        case when kind = 'OBJECT' and not ({bad}) then case when len(list_filter(json_keys(txt), lambda x: x = 'k')) > 1
          then list_last(regexp_extract_all(txt, '"k": ?([^,}}]+)', 1)) else json_extract_string(txt, '$.k') end end as k from q"""


for _strict in (False, True):
    def _replies(spark, sf, strict=_strict):
        df = R.validate_replies(load(spark, sf, "replies"), "reply", ["k", "a"], {"a": 7}, strict)
        return df.select("event_id", "status", "missing", F.col("fields")["a"].alias("a"), F.col("fields")["k"].alias("k"))
    query("reply_validation_strict" if _strict else "reply_validation", replies_sql(_strict))(_replies)
