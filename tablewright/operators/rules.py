"""Deterministic decisions over tables of datasets, runs, steps and replies."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from tablewright.functions.columns import ref

SUMMARY_CHARS = 500  # of a step's texts in the roll-up
FENCE = "```"

# Required keys and defaults of the known reply kinds.
REPLY_KINDS = {
    "routing": (["path", "suggested_target", "model_recommendations", "reasoning"],
                {"path": "supervised", "suggested_target": None,
                 "model_recommendations": ["RandomForest"], "reasoning": ""}),
    "outliers": (["recommended_strategy"],
                 {"recommended_strategy": "cap", "reasoning": "Default: cap outliers at IQR bounds",
                  "per_column_notes": {}}),
    "review": (["reasoning"],
               {"reasoning": "", "features_to_drop": [], "new_features": [], "next_model": None,
                "next_ga_generations": 5, "next_ga_pop_size": 10}),
    "features": ([], {"features": []}),
}


# Limits and issue texts of the review.
OVERFIT_GAP, DOMINANT_SHARE, LOW_SCORE, LEAK_SCORE = 0.10, 0.50, 0.85, 0.999
ISSUE_TEXTS = {
    "overfit": "OVERFITTING DETECTED (Train %s vs Test %s).",
    "dominated": "FEATURE DOMINANCE DETECTED ('%s' contributes %s!).",
    "under": "UNDERPERFORMING (Test score %s < 0.85 Target).",
    "leak": "DATA LEAKAGE DETECTED (Test score %s >= 0.999 is suspiciously perfect. "
            "A feature is likely leaking the target variable).",
}


def fixed(number: Column, digits: int) -> Column:
    """Fixed-point text, rounded on the exact binary value as printf does."""
    return F.call_function("format_number", number, F.lit("0." + "0" * digits))


def triage(catalogue: DataFrame) -> DataFrame:
    """Route each dataset row (confidence, num_rows, num_columns) by both rule sets."""
    confidence = F.coalesce(F.col("confidence"), F.lit(0.0))
    wide = (F.col("num_columns") > 20) & (F.col("num_rows") > 100)
    return catalogue.withColumns({
        "path": F.when(confidence > 0.3, "supervised").otherwise("unsupervised"),
        "task_type": F.when(confidence > 0.3, "classification").otherwise("clustering"),
        "path_v0": F.when(confidence > 0.5, "supervised").when(wide, "unsupervised")
        .otherwise("supervised"),
        "confidence_level": F.when(confidence > 0.7, "High").otherwise("Medium"),
    })


def review(runs: DataFrame, importances: DataFrame, iteration: Column, max_iterations: int = 3,
           run: str = "run_id") -> DataFrame:
    """Verdict on each run from its train and test score and its largest importance.

    `runs` holds (run, train_score, test_score), `importances` (run, feature, importance).
    """
    top = (importances.groupBy(run)
           .agg(F.min(F.struct((-F.col("importance")).alias("neg"), F.col("feature"))).alias("t"))
           .select(run, (-F.col("t.neg")).alias("max_importance"), F.col("t.feature").alias("top_feature")))
    train, test = F.col("train_score"), F.col("test_score")
    largest = F.coalesce(F.col("max_importance"), F.lit(0.0))
    three = lambda c: fixed(c, 3)
    flags = {"overfit": train - test > OVERFIT_GAP, "dominated": largest > DOMINANT_SHARE,
             "under": test < LOW_SCORE, "leak": test >= LEAK_SCORE}
    out = runs.join(top, run, "left").withColumns(flags)
    said = {"overfit": [three(train), three(test)], "dominated": [F.col("top_feature"), three(largest)],
            "under": [three(test)], "leak": [three(test)]}
    shown = {f: F.col(f) for f in flags} | {"under": F.col("under") & ~F.col("overfit")}
    issues = F.concat_ws(" ", *[F.when(shown[f], F.format_string(ISSUE_TEXTS[f], *said[f])) for f in flags])
    wanting = F.col("overfit") | F.col("dominated") | F.col("under") | F.col("leak")
    done = ~wanting | (iteration >= max_iterations)
    return out.withColumns({"status": F.when(done, "satisfied").otherwise("retry"),
                            "issues": F.when(~done, issues)})


def best_run(runs: DataFrame, order: str = "run_id") -> DataFrame:
    """The run with the highest test score, the first one on a tie."""
    return runs.orderBy(F.desc("test_score"), order).limit(1)


def leaderboard(results: DataFrame) -> DataFrame:
    """Report columns of a results table (dataset, ori, mu, fitness, gap, model, and error if it has one)."""
    errors = ["error"] if "error" in results.columns else []
    return results.select("dataset", fixed(F.col("ori"), 3).alias("ori"),
                          fixed(F.col("mu"), 4).alias("best_mu_cv"), fixed(F.col("fitness"), 4).alias("fitness"),
                          fixed(F.col("gap"), 4).alias("gap"), "model", *errors)


def trace_steps(steps: DataFrame, chars: int | None = SUMMARY_CHARS) -> DataFrame:
    """Duration in ms and summaries, cut to `chars` unless None, of raw steps (started_at, finished_at in s)."""
    short = (lambda c: F.substring(c, 1, chars)) if chars is not None else F.col
    took = F.round((F.col("finished_at") - F.col("started_at")) * 1000, 1)
    return steps.withColumns({
        "duration_ms": F.when(F.col("status").isin("success", "error"), took).otherwise(0.0),
        "input_summary": short("input_summary"),
        "output_summary": short("output_summary")})


def trace_rollup(steps: DataFrame, by=("agent_name",)) -> DataFrame:
    """Steps, time and status counts per agent; pending steps add no time."""
    status = F.col("status")
    count = lambda s: F.count(F.when(status == s, 1)).alias(f"n_{s}")
    return steps.groupBy(*by).agg(
        F.count("*").alias("total_steps"),
        F.coalesce(F.sum(F.when(status != "pending", F.col("duration_ms"))), F.lit(0.0))
        .alias("total_duration_ms"),
        *[count(s) for s in ("pending", "running", "success", "error")])


def unfenced(reply: Column) -> Column:
    """The reply without its code-fence lines."""
    trimmed = F.regexp_replace(reply, r"^\s+|\s+$", "")
    lines = F.filter(F.split(trimmed, "\n", -1),
                     lambda line: ~F.regexp_replace(line, r"^\s+", "").startswith(FENCE))
    return F.when(trimmed.startswith(FENCE), F.array_join(lines, "\n")).otherwise(trimmed)


def _text(value) -> str | None:
    return value if value is None or isinstance(value, str) else json.dumps(value)


def _json_value(text: Column) -> Column:
    """Whether the whole text is one JSON value: it is the only element when wrapped as an array, and the only
    member when wrapped as an object (text that closes one wrapping early breaks the other)."""
    single = F.json_array_length(F.concat(F.lit("["), text, F.lit("]"))) == 1
    member = F.size(F.json_object_keys(F.concat(F.lit('{"x":'), text, F.lit("}")))) == 1
    return F.coalesce(single & member, F.lit(False))


def _last_values(fields: Column) -> Column:
    """A map with the last value of each repeated key."""
    pairs = F.map_entries(fields)
    again = lambda pair, i: F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda later: later["key"] == pair["key"])
    return F.map_from_entries(F.filter(pairs, lambda pair, i: ~again(pair, i)))


def validate_replies(df: DataFrame, reply: str, required: list[str] = (), defaults: dict | None = None,
                     strict: bool = False) -> DataFrame:
    """Adds status, missing keys and the filled fields of each reply.

    status is ok, invalid_json, not_object or, when strict, missing_required. Anything but white space after
    the value makes a reply invalid; of a repeated key the last value counts.
    """
    out = df.withColumn("_clean", unfenced(ref(reply))).withColumn("_json", _json_value(F.col("_clean")))
    is_object = F.col("_json") & F.col("_clean").rlike(r"^\s*\{")
    out = out.withColumn("_fields", F.when(is_object, _last_values(F.from_json("_clean", "map<string,string>"))))
    required_keys = F.array(*[F.lit(k) for k in required]).cast("array<string>")
    missing = F.filter(required_keys, lambda k: ~F.map_contains_key("_fields", k))
    defaults = {k: _text(v) for k, v in (defaults or {}).items()}
    extra = F.create_map(*[x for k, v in defaults.items() for x in (F.lit(k), F.lit(v))]) \
        .cast("map<string,string>") if defaults else F.create_map().cast("map<string,string>")
    absent = F.map_filter(extra, lambda k, _: ~F.map_contains_key("_fields", k))
    out = out.withColumn("missing", F.when(F.col("_fields").isNotNull(), missing))
    failed = F.lit(strict) & (F.size("missing") > 0)
    status = (F.when(~F.col("_json"), "invalid_json")
              .when(F.col("_fields").isNull(), "not_object")
              .when(failed, "missing_required").otherwise("ok"))
    filled = F.when(F.col("_fields").isNotNull() & ~failed, F.map_concat("_fields", absent))
    return out.withColumns({"status": status, "fields": filled}).drop("_clean", "_json", "_fields")


def preview(df: DataFrame, order: list[str], rows: int = 15, columns: int = 20, width: int = 15) -> DataFrame:
    """First rows in key order, cells cut to a fixed width."""
    names = df.columns[:columns]
    head = df.orderBy(*[ref(c) for c in order]).select(*[ref(c) for c in names]).limit(rows)
    return head.select(*[F.substring(ref(c).cast("string"), 1, width).alias(c) for c in names])
