"""Registry of queries with their SQL, and the derived input views both engines share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLES: dict[str, str] = {}

VIEWS = {
    "dirty_events": """
        select event_id, ts, user_id,
          case when event_id % 11 = 0 then null else event_type end as event_type,
          case when event_id % 7 = 0 then null
               when event_id % 501 = 0 then cast('Infinity' as double)
               when event_id % 503 = 0 then cast('-Infinity' as double)
               when event_id % 499 = 0 then cast('NaN' as double)
               when event_id % 97 = 0 then value * 20
               else value end as value,
          case when event_id % 2 = 0 then null else value * 2 + user_id end as half_null,
          cast(1.0 as double) as const_col,
          event_id % 3 = 0 as is_third,
          props
        from events""",
    "replies": """
        select event_id,
          case when event_id % 11 = 0 then concat('```json', chr(10), props, chr(10), '```')
               when event_id % 11 = 1 then 'no object here'
               when event_id % 11 = 2 then '[4, 5]'
               when event_id % 11 = 3 then '{"a": 1}'
               when event_id % 11 = 4 then concat(props, ' Hope this helps!')
               when event_id % 11 = 5 then '{"k":1,"a":2}{"x":1}'
               when event_id % 11 = 6 then '{"k":1,"k":2,"a":3}'
               when event_id % 11 = 7 then '{"k":{"z":1},"a":"x"}'
               when event_id % 11 = 8 then ''
               when event_id % 11 = 9 then '{"k":1}, {"k":2}'
               else props end as reply
        from events""",
    "preds": """
        select doc_id, quality as label,
          case when doc_id % 5 = 0 then toxic else quality end as pred
        from labels""",
    "preds3": """
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag as label,
          case when l_orderkey % 7 = 0 then 'X'
               when l_orderkey % 4 = 0 then 'A'
               else l_returnflag end as pred
        from lineitem""",
    "reg_preds": """
        select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice as y,
          l_extendedprice + (l_orderkey % 13 - 6) * 1000 as p,
          case when l_orderkey % 5 = 0 then 'test' else 'train' end as split
        from lineitem""",
    "planted": """
        select o_orderkey, x1, x2, x3, seg, y_reg,
          case when y_reg < 7 then 'lo' when y_reg < 10 then 'mid' else 'hi' end as y_cls
        from (select o_orderkey, o_totalprice / 100000 as x1,
                (o_custkey % 97) / cast(97 as double) as x2,
                (o_orderkey % 31) / cast(31 as double) as x3,
                o_orderpriority as seg,
                3 * (o_totalprice / 100000) + 2 * ((o_custkey % 97) / cast(97 as double))
                  + ((o_orderkey * 7919) % 101 - 50) / cast(200 as double) as y_reg
              from orders) o""",
    "blobs": """
        select p_partkey as id,
          case when p_partkey % 200 = 0 then 100 + p_partkey * cast(1 as double)
               else 10 * (p_partkey % 3) + ((p_partkey * 7919) % 101) / cast(100 as double) end as x,
          case when p_partkey % 200 = 0 then -100 - p_partkey * cast(1 as double)
               else 5 * (p_partkey % 3) + ((p_partkey * 104729) % 103) / cast(100 as double) end as y
        from part""",
    "candidates": """
        select p_partkey as cand_id,
          case p_partkey % 4 when 0 then 'RandomForest' when 1 then 'GradientBoosting'
               when 2 then 'DecisionTree' else 'LogisticRegression' end as model,
          p_partkey % 5 + 1 as gen,
          50 + 50 * (p_partkey % 5) as n_estimators,
          case when p_size % 7 = 0 then null else p_size % 20 end as max_depth,
          1 + p_partkey % 10 as n_selected, 10 as n_features,
          p_retailprice / 2500 as mu,
          p_size / cast(500 as double) as sigma,
          p_size / cast(400 as double) as gap
        from part""",
    "runs": """
        select p_partkey as run_id, p_retailprice / 2003 as train_score,
          p_retailprice / 2003 - (p_size - 10) / cast(200 as double) as test_score,
          p_partkey % 4 + 1 as iteration
        from part""",
    "run_importances": """
        select l_partkey as run_id, concat(l_returnflag, l_linestatus) as feature,
          max(l_quantity) / 80 as importance
        from lineitem group by l_partkey, concat(l_returnflag, l_linestatus)""",
    "steps": """
        select event_id, event_type as agent_name, cast(event_id as double) as started_at,
          event_id + value / 1000 as finished_at,
          case user_id % 5 when 0 then 'pending' when 1 then 'running' when 2 then 'error'
               else 'success' end as status,
          repeat(props, 60) as input_summary, props as output_summary
        from events""",
}

# Families and SQL-side types of the profiled tables, in column order.
COLUMNS = {
    "lineitem": [("l_orderkey", "numeric"), ("l_partkey", "numeric"), ("l_suppkey", "numeric"),
                 ("l_linenumber", "numeric"), ("l_quantity", "numeric"), ("l_extendedprice", "numeric"),
                 ("l_discount", "numeric"), ("l_tax", "numeric"), ("l_returnflag", "string"),
                 ("l_linestatus", "string"), ("l_shipdate", "datetime")],
    "orders": [("o_orderkey", "numeric"), ("o_custkey", "numeric"), ("o_orderstatus", "string"),
               ("o_totalprice", "numeric"), ("o_orderdate", "datetime"), ("o_orderpriority", "string")],
    "customer": [("c_custkey", "numeric"), ("c_name", "string"), ("c_nationkey", "numeric"),
                 ("c_acctbal", "numeric"), ("c_mktsegment", "string")],
    "supplier": [("s_suppkey", "numeric"), ("s_name", "string"), ("s_nationkey", "numeric"),
                 ("s_acctbal", "numeric")],
    "part": [("p_partkey", "numeric"), ("p_name", "string"), ("p_brand", "string"), ("p_type", "string"),
             ("p_size", "numeric"), ("p_retailprice", "numeric")],
    "documents": [("doc_id", "numeric"), ("text", "string"), ("lang", "string"), ("source", "string"),
                  ("n_chars", "numeric")],
    "dirty_events": [("event_id", "numeric"), ("ts", "datetime"), ("user_id", "numeric"),
                     ("event_type", "string"), ("value", "numeric"), ("half_null", "numeric"),
                     ("const_col", "numeric"), ("is_third", "boolean"), ("props", "string")],
    "planted": [("o_orderkey", "numeric"), ("x1", "numeric"), ("x2", "numeric"), ("x3", "numeric"),
                ("seg", "string"), ("y_reg", "numeric"), ("y_cls", "string")],
}
WIDTHS = {"l_linenumber": 4, "c_nationkey": 4, "s_nationkey": 4, "p_size": 4, "is_third": 1}

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
               "pages benchmark labels conversations").split()


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, or one of the derived views over them."""
    if name in BASE_TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = VIEWS[name]
    for table in BASE_TABLES:
        if f"from {table}" in text:
            load(spark, sf_dir, table).createOrReplaceTempView(table)
    return spark.sql(text)


def query(name: str, sql: str | None = None):
    """Register fn(spark, sf_dir) under a name, with its SQL where there is one."""
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


# SQL text helpers.

def numerics(table: str, skip=()) -> list[str]:
    return [c for c, f in COLUMNS[table] if f == "numeric" and c not in skip]


def source(table: str) -> str:
    """CTE `t`: the table with non-finite values as NULL and a DOUBLE twin of every numeric column."""
    inner = f"({VIEWS[table]})" if table in VIEWS else table
    cells = [f"case when isfinite(cast({c} as double)) then cast({c} as double) end as {c}"
             if f == "numeric" else c for c, f in COLUMNS[table]]
    return f"with t as (select {', '.join(cells)} from {inner} as src)"


def union(parts: list[str]) -> str:
    return " union all ".join(parts)


def view(name: str) -> str:
    return f"with {name} as ({VIEWS[name]})"
