"""Every registered query over the event logs, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import rules, upcasts, validate, values
from tidemark.operators import compiled, fold, log, mutations
from tidemark.operators.running import running
from tidemark.plans import orders
from tidemark.schema.parser import parse
from tidemark.sources.events import activity_log, dense_positions, order_log, table, with_versions

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: The activity log in SQL.
A = """a AS (SELECT event_id AS position, 'user-' || user_id AS stream_id, user_id, 'Activity.' || event_type AS family, event_type AS name, ts, CAST(value AS DECIMAL(18,2)) AS value,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 + 1 AS type_version,
    row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS stream_version FROM events)"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


# ---- reads -------------------------------------------------------------------------------------------------------


@query(f"WITH {A} SELECT position, stream_id, family FROM a WHERE position >= 100 ORDER BY position LIMIT 50")
def read_all_range(spark: SparkSession, sf: str) -> DataFrame:
    return log.read_all(activity_log(spark, sf), 100, 50).select("position", "stream_id", "family")


@query(f"WITH {A} SELECT position, stream_id, family FROM a WHERE position <= 500 ORDER BY position DESC LIMIT 50")
def read_all_backward(spark: SparkSession, sf: str) -> DataFrame:
    return log.read_all_backward(activity_log(spark, sf), 500, 50).select("position", "stream_id", "family")


@query(f"WITH {A} SELECT position, stream_version FROM a WHERE stream_id = 'user-3' AND stream_version >= 5 ORDER BY stream_version LIMIT 20")
def read_stream_fwd(spark: SparkSession, sf: str) -> DataFrame:
    return log.read_stream(activity_log(spark, sf), "user-3", 5, limit=20).select("position", F.col("stream_version").cast("long").alias("stream_version"))


@query(f"WITH {A} SELECT position, stream_version FROM a WHERE stream_id = 'user-3' AND stream_version <= 30 ORDER BY stream_version DESC LIMIT 20")
def read_stream_bwd(spark: SparkSession, sf: str) -> DataFrame:
    return log.read_stream(activity_log(spark, sf), "user-3", 30, True, 20).select("position", F.col("stream_version").cast("long").alias("stream_version"))


@query(f"WITH {A} SELECT position, stream_id, k FROM a WHERE family = 'Activity.purchase' AND position >= 50 ORDER BY position LIMIT 100")
def read_by_type(spark: SparkSession, sf: str) -> DataFrame:
    return log.read_by_type(activity_log(spark, sf), "Activity.purchase", 50, 100).select("position", "stream_id", "k")


@query(f"WITH {A} SELECT position, stream_id, k FROM a WHERE family = 'Activity.purchase' AND type_version = 2 AND position >= 50 ORDER BY position LIMIT 100")
def read_by_type_version(spark: SparkSession, sf: str) -> DataFrame:
    return log.read_by_type(activity_log(spark, sf), "Activity.purchase", 50, 100, 2).select("position", "stream_id", "k")


@query(f"WITH {A} SELECT stream_id, count(*) - 1 AS last_version, max(position) AS last_position, arg_max(family, position) AS last_family FROM a GROUP BY stream_id")
def stream_heads(spark: SparkSession, sf: str) -> DataFrame:
    return log.stream_heads(activity_log(spark, sf))


@query(f"WITH {A} SELECT DISTINCT stream_id FROM a WHERE starts_with(stream_id, 'user-1')")
def list_streams_prefix(spark: SparkSession, sf: str) -> DataFrame:
    return log.list_streams(activity_log(spark, sf), "user-1")


@query(f"WITH {A} SELECT position, stream_id, stream_version FROM a")
def stream_version_assign(spark: SparkSession, sf: str) -> DataFrame:
    return with_versions(activity_log(spark, sf)).select("position", "stream_id", F.col("stream_version").cast("long").alias("stream_version"))


@query(f"WITH {A} SELECT CAST(floor(position / 10) AS BIGINT) AS batch_id, max(position) AS last_position, count(*) AS n_events FROM a GROUP BY 1")
def batch_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    return log.batch_ends(activity_log(spark, sf), F.floor(F.col("position") / 10))


@query("SELECT o_orderkey AS order_id, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS position FROM orders")
def global_position_assign(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders")
    return dense_positions(o, F.to_date("o_orderdate"), "o_orderdate", "o_orderkey").select(F.col("o_orderkey").alias("order_id"), F.col("position").cast("long").alias("position"))


# ---- rules and values --------------------------------------------------------------------------------------------


@query(f"""WITH {A} SELECT position, CAST(value AS DOUBLE) AS value, k FROM a
    WHERE (value >= 5.00 AND NOT (k IN (1, 2, 3)) AND length(stream_id) <= 7) OR regexp_matches(family, '^Activity\\.p')""")
def rule_filter_money(spark: SparkSession, sf: str) -> DataFrame:
    a = activity_log(spark, sf)
    rule = 'value >= 5.00 and not k in [1, 2, 3] and len(stream_id) <= 7 or family matches "^Activity[.]p"'
    return a.where(rules.compile_rule(rule, a.schema)).select("position", F.col("value").cast("double").alias("value"), "k")


@query(f"""WITH {A}, e AS (SELECT CASE WHEN NOT value >= 3 THEN 1 ELSE 0 END AS x, CASE WHEN NOT (k >= 10 AND k < 90) THEN 1 ELSE 0 END AS y, CASE WHEN NOT name <> 'error' THEN 1 ELSE 0 END AS z FROM a)
    SELECT 'Least' AS rule, count(*) AS n FROM e WHERE x = 1 UNION ALL SELECT 'Range', count(*) FROM e WHERE y = 1 UNION ALL SELECT 'NoError', count(*) FROM e WHERE z = 1""")
def validate_errors_count(spark: SparkSession, sf: str) -> DataFrame:
    found = rules.violations(activity_log(spark, sf), {"Least": "value >= 3", "Range": "k >= 10 and k < 90", "NoError": 'name != "error"'})
    return found.select(F.explode("errors").alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {A} SELECT position, coalesce(CASE WHEN k >= 50 THEN k END, 7) AS n, coalesce(CASE WHEN k % 3 = 0 THEN name END, 'none') AS label, CASE WHEN k % 5 = 0 THEN k END AS optional FROM a")
def apply_defaults(spark: SparkSession, sf: str) -> DataFrame:
    a = activity_log(spark, sf).select("position", F.when(F.col("k") >= 50, F.col("k")).alias("n"), F.when(F.col("k") % 3 == 0, F.col("name")).alias("label"), F.when(F.col("k") % 5 == 0, F.col("k")).alias("optional"))
    return values.upcast(a, {"position": "bigint", "n": "bigint", "label": "string", "optional": "bigint"}, defaults={"n": 7, "label": "none"})


@query(f"WITH {A} SELECT position, k AS amount, 'legacy' AS note, 1 AS qty, CAST(NULL AS VARCHAR) AS extra FROM a WHERE type_version = 1")
def upcast_v1_v2(spark: SparkSession, sf: str) -> DataFrame:
    old = activity_log(spark, sf).where("type_version = 1").select("position", "k", "name")
    return values.upcast(old, {"position": "bigint", "amount": "bigint", "note": "string", "qty": "int", "extra": "string"}, {"note": "legacy"}, {"k": "amount"}, {"qty": 1})


@query(f"WITH {A} SELECT position, k AS total, CASE WHEN type_version = 1 THEN 'legacy' ELSE name END AS note, 'EUR' AS currency FROM a")
def upcast_chain(spark: SparkSession, sf: str) -> DataFrame:
    a = activity_log(spark, sf)
    v2 = {"position": "bigint", "amount": "bigint", "note": "string"}
    first = values.upcast(a.where("type_version = 1").select("position", "k"), v2, {"note": "legacy"}, {"k": "amount"})
    second = a.where("type_version = 2").select("position", F.col("k").alias("amount"), F.col("name").alias("note"))
    return values.upcast(first.unionByName(second), {"position": "bigint", "total": "bigint", "note": "string", "currency": "string"}, rename={"amount": "total"}, defaults={"currency": "EUR"})


@query("SELECT event_id AS position, 'user-' || user_id || '/log' AS stream_id, CAST(user_id AS VARCHAR) AS key, CASE WHEN user_id % 2 = 0 THEN CAST(user_id AS VARCHAR) END AS other FROM events")
def template_render_match(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    stream = values.render("user-{id}/log", F.col("user_id"))
    odd = F.when(F.col("user_id") % 2 == 1, F.concat(F.lit("user-0"), F.col("user_id").cast("string"))).otherwise(F.concat(F.lit("user-"), F.col("user_id").cast("string")))
    return e.select(F.col("event_id").alias("position"), stream.alias("stream_id"), values.match("user-{id}/log", stream, "uint").alias("key"), values.match("user-{id}", odd, "uint").alias("other"))


@query("SELECT DISTINCT 'Activity.' || event_type || '@v2' AS ref, 'Activity' AS context, event_type AS name, 2 AS version FROM events")
def event_references(spark: SparkSession, sf: str) -> DataFrame:
    ref = F.concat(F.lit("Activity."), F.col("event_type"), F.lit("@v2"))
    return table(spark, sf, "events").select(ref.alias("ref")).distinct().select("ref", values.event_ref(F.col("ref")).alias("r")).select("ref", "r.context", "r.name", "r.version")


@query("SELECT event_id AS position, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, len(json_keys(props)) AS n_fields FROM events")
def json_payload_extract(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(F.col("event_id").alias("position"), F.get_json_object("props", "$.k").cast("long").alias("k"), F.size(F.json_object_keys("props")).cast("long").alias("n_fields"))


@query("""WITH t AS (SELECT DISTINCT CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS t FROM lineitem)
    SELECT t, 2 AS scale, CASE WHEN t LIKE '%.00' THEN replace(t, '.00', '') WHEN t LIKE '%0' THEN left(t, length(t) - 1) ELSE t END AS key, false AS is_int FROM t""")
def decimal_forms(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem").select(F.col("l_extendedprice").cast("decimal(18,2)").cast("string").alias("t")).distinct()
    return t.select("t", values.scale_of(F.col("t")).alias("scale"), values.decimal_key(F.col("t")).alias("key"), values.accepts("int", F.col("t")).alias("is_int"))


# ---- folds -------------------------------------------------------------------------------------------------------


def _ops(spark: SparkSession, sf: str) -> DataFrame:
    """The activity log as operations on a row per user."""
    a = activity_log(spark, sf)
    return a.select("user_id", F.col("position").alias("ord"), "name", "k", "value", "position")


@query(f"WITH {A} SELECT user_id, CAST(sum(value) AS DOUBLE) AS total, count(*) AS n FROM a GROUP BY user_id")
def fold_add(spark: SparkSession, sf: str) -> DataFrame:
    return _ops(spark, sf).groupBy("user_id").agg(F.sum("value").cast("double").alias("total"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {A}, s AS (SELECT user_id, name, sum(value) AS v FROM a GROUP BY ALL) SELECT user_id, string_agg(name || '=' || CAST(v AS DECIMAL(28,2)), ',' ORDER BY name) AS spent FROM s GROUP BY user_id")
def fold_add_map_key(spark: SparkSession, sf: str) -> DataFrame:
    ops = _ops(spark, sf).select("user_id", "ord", F.lit("add").alias("op"), F.col("name").alias("map_key"), "value")
    rows = fold.entries(ops, ["user_id"])
    text = F.concat_ws("=", "map_key", F.col("value").cast("decimal(28,2)").cast("string"))
    return rows.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(text)), ",").alias("spent"))


@query(f"WITH {A} SELECT user_id, CAST(arg_max(value, position) AS DOUBLE) AS last_value, arg_max(name, position) AS last_name FROM a GROUP BY user_id")
def fold_set_last(spark: SparkSession, sf: str) -> DataFrame:
    ops = _ops(spark, sf).withColumn("value", F.struct("value", "name"))
    return fold.latest(ops, ["user_id"]).select("user_id", F.col("value.value").cast("double").alias("last_value"), F.col("value.name").alias("last_name"))


@query(f"""WITH {A}, s AS (SELECT user_id, k % 20 AS e, arg_max(name IN ('click', 'view', 'purchase'), position) AS there FROM a GROUP BY ALL)
    SELECT user_id, string_agg(CAST(e AS VARCHAR), ',' ORDER BY e) AS elements FROM s WHERE there GROUP BY user_id""")
def fold_set_add_remove(spark: SparkSession, sf: str) -> DataFrame:
    ops = _ops(spark, sf).select("user_id", "ord", F.when(F.col("name").isin("click", "view", "purchase"), "set_add").otherwise("set_remove").alias("op"), (F.col("k") % 20).alias("element"))
    return fold.members(ops, ["user_id"]).select("user_id", F.array_join(F.col("elements").cast("array<string>"), ",").alias("elements"))


@query(f"WITH {A}, r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY position DESC) AS n FROM a) SELECT user_id, string_agg(CAST(k AS VARCHAR), ',' ORDER BY position) AS items FROM r WHERE n <= 5 GROUP BY user_id")
def fold_list_last5(spark: SparkSession, sf: str) -> DataFrame:
    return fold.last_n(_ops(spark, sf).select("user_id", "ord", F.col("k").alias("value")), ["user_id"], 5).select("user_id", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"))


@query(f"""WITH {A}, o AS (SELECT user_id, k % 10 AS mk, position, value, CASE WHEN name IN ('click', 'purchase') THEN 'put' WHEN name = 'error' THEN 'remove' ELSE 'add' END AS op FROM a),
    s AS (SELECT *, max(CASE WHEN op <> 'add' THEN position END) OVER (PARTITION BY user_id, mk) AS reset FROM o)
    SELECT user_id, mk AS map_key, CAST(sum(value) AS DOUBLE) AS value FROM s WHERE (reset IS NULL OR position >= reset) AND op <> 'remove' GROUP BY ALL""")
def fold_map_put_remove(spark: SparkSession, sf: str) -> DataFrame:
    op = F.when(F.col("name").isin("click", "purchase"), "map_put").when(F.col("name") == "error", "map_remove").otherwise("add")
    ops = _ops(spark, sf).select("user_id", "ord", op.alias("op"), (F.col("k") % 10).alias("map_key"), "value")
    return fold.entries(ops, ["user_id"]).withColumn("value", F.col("value").cast("double"))


_ROW_OPS = "CASE WHEN name = 'signup' THEN 'upsert' WHEN name = 'error' AND k < 10 THEN 'delete' ELSE 'add' END"


@query(f"""WITH {A}, o AS (SELECT user_id, position, {_ROW_OPS} AS op, CASE WHEN name = 'signup' THEN k ELSE 1 END AS v FROM a),
    s AS (SELECT *, max(CASE WHEN op <> 'add' THEN position END) OVER (PARTITION BY user_id) AS reset FROM o)
    SELECT user_id, CAST(sum(v) AS BIGINT) AS n FROM s WHERE (reset IS NULL OR position >= reset) AND op <> 'delete' GROUP BY user_id""")
def fold_upsert_delete(spark: SparkSession, sf: str) -> DataFrame:
    """Row and number of each user in one pass: the last reset, then one sum of what follows it."""
    ops = _ops(spark, sf).select("user_id", "ord", F.expr(_ROW_OPS).alias("op"), F.expr("CASE WHEN name = 'signup' THEN k ELSE 1 END").alias("value"))
    rest = fold.after_reset(ops, ["user_id"], fold.RESETS).where("op != 'delete'")
    return rest.groupBy("user_id").agg(F.sum("value").alias("n"))


#: A table whose columns the activity log's events change in every way that commutes.
BOARD = """
layer derivation
projection Activity.Board {
  from Activity.signup, Activity.error, Activity.click, Activity.view, Activity.purchase
  fold wasm "board.wasm"
  table board { key user_id: int, n: int, mark: string?, tags: set<int>, spent: map<string, decimal> }
}
"""
_BOARD_OPS = """CASE WHEN name = 'signup' THEN 'upsert' WHEN name = 'error' AND k < 10 THEN 'delete' WHEN name = 'error' THEN 'set_remove' WHEN name = 'click' THEN 'set_add'
    WHEN name = 'view' AND k % 5 = 0 THEN 'set' WHEN name = 'view' THEN 'add' WHEN k % 3 = 0 THEN 'map_remove' WHEN k % 3 = 1 THEN 'map_put' ELSE 'map_add' END"""


@query(f"""WITH {A}, o AS (SELECT user_id, position, k, value, {_BOARD_OPS} AS op FROM a),
    l AS (SELECT *, max(CASE WHEN op IN ('upsert', 'delete') THEN position END) OVER u AS cut, last_value(op) OVER (PARTITION BY user_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last_op,
        max(CASE WHEN op = 'set' THEN position END) OVER u AS setting FROM o WINDOW u AS (PARTITION BY user_id)),
    r AS (SELECT * FROM l WHERE last_op <> 'delete' AND (cut IS NULL OR position >= cut)),
    n AS (SELECT user_id, CAST(coalesce(sum(k) FILTER (op IN ('upsert', 'add', 'set') AND (setting IS NULL OR position >= setting)), 0) AS BIGINT) AS n, arg_max('m' || k, position) FILTER (op = 'upsert') AS mark FROM r GROUP BY user_id),
    e AS (SELECT user_id, CASE WHEN op = 'upsert' THEN k % 3 ELSE k % 7 END AS e, arg_max(op <> 'set_remove', position) AS there FROM r WHERE op IN ('upsert', 'set_add', 'set_remove') GROUP BY ALL),
    t AS (SELECT user_id, string_agg(CAST(e AS VARCHAR), ',' ORDER BY e) AS tags FROM e WHERE there GROUP BY user_id),
    m AS (SELECT user_id, 'c' || k % 4 AS c, op, value, position, max(CASE WHEN op <> 'map_add' THEN position END) OVER (PARTITION BY user_id, k % 4) AS since FROM r WHERE op LIKE 'map%'),
    x AS (SELECT user_id, c, sum(value) AS v FROM m WHERE (since IS NULL OR position >= since) AND op <> 'map_remove' GROUP BY ALL),
    s AS (SELECT user_id, string_agg(c || '=' || CAST(v AS DECIMAL(28,2)), ',' ORDER BY c) AS spent FROM x GROUP BY user_id)
    SELECT n.user_id, n, mark, coalesce(tags, '') AS tags, coalesce(spent, '') AS spent FROM n LEFT JOIN t USING (user_id) LEFT JOIN s USING (user_id)""")
def fold_schema_table(spark: SparkSession, sf: str) -> DataFrame:
    """A table compiled from its declaration: upserts, deletes, sets, adds, set and map operations mixed on each row."""
    op, k = F.expr(_BOARD_OPS), F.col("k")
    column = F.when(op.isin("set", "add"), "n").when(op.isin("set_add", "set_remove"), "tags").when(op.startswith("map"), "spent")
    value = F.when(op.isin("set", "add"), k.cast("string")).when(op.startswith("set_"), (k % 7).cast("string")).when(op.startswith("map"), F.col("value").cast("string"))
    row = F.when(op == "upsert", F.to_json(F.struct(k.alias("n"), F.concat(F.lit("m"), k.cast("string")).alias("mark"), F.array(k % 3).alias("tags"))))
    ops = activity_log(spark, sf).select("user_id", F.col("position").alias("ord"), F.when(op == "map_add", "add").otherwise(op).alias("op"), column.alias("column"), value.alias("value"), F.concat(F.lit("c"), (k % 4).cast("string")).alias("map_key"), row.alias("row"))
    made = compiled.fold_table(ops, parse(BOARD).projections["Activity.Board"].tables["board"])
    spent = F.array_join(F.transform(F.map_entries("spent"), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",")
    return made.select("user_id", "n", "mark", F.array_join(F.col("tags").cast("array<string>"), ",").alias("tags"), spent.alias("spent"))


@query(f"""WITH {A}, r AS (SELECT user_id, position, sum(CASE WHEN name = 'error' THEN -k ELSE 10 END) OVER (PARTITION BY user_id ORDER BY position) AS run FROM a)
    SELECT user_id, min(position) AS first_failure FROM r WHERE run < 0 GROUP BY user_id""")
def fold_uint_underflow_first(spark: SparkSession, sf: str) -> DataFrame:
    ops = _ops(spark, sf).select("user_id", "ord", F.lit("add").alias("op"), F.expr("CASE WHEN name = 'error' THEN -k ELSE 10 END").alias("value"))
    return fold.first_underflow(ops, ["user_id"])


@query(f"""WITH RECURSIVE {A}, o AS (SELECT user_id, k % 8 AS x, name, stream_version AS n FROM a),
    f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST([] AS BIGINT[]) AS l FROM o WHERE n = 0
      UNION ALL SELECT f.user_id, f.n + 1, CASE WHEN o.name = 'error' THEN list_filter(f.l, lambda y: y <> o.x) ELSE list_append(f.l, o.x) END FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n),
    g AS (SELECT user_id, arg_max(l, n) AS l FROM f GROUP BY user_id)
    SELECT user_id, array_to_string(l, ',') AS items FROM g""")
def fold_list_remove_sequential(spark: SparkSession, sf: str) -> DataFrame:
    """Pushes and removals do not commute: a higher-order fold over each row's ops in order."""
    ops = activity_log(spark, sf).select("user_id", F.col("position").alias("ord"), "name", (F.col("k") % 8).alias("x"))
    step = lambda s, o: F.when(o["name"] == "error", F.filter(s, lambda y: y != o["x"])).otherwise(F.array_append(s, o["x"]))
    done = fold.sequential(ops, ["user_id"], F.array().cast("array<bigint>"), step)
    return done.select("user_id", F.array_join(F.col("state").cast("array<string>"), ",").alias("items"))


# ---- orders ------------------------------------------------------------------------------------------------------


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, arg_max(CAST(l_quantity AS DECIMAL(18,2)), (l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate)) AS qty FROM lineitem GROUP BY ALL)
    SELECT o_orderkey AS order_id, CASE WHEN o_orderstatus = 'F' THEN 'Cancelled' ELSE 'Pending' END AS status, count(l_linenumber) AS n_lines, CAST(coalesce(sum(qty), 0) AS DOUBLE) AS qty
    FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY ALL""")
def aggregate_state_order(spark: SparkSession, sf: str) -> DataFrame:
    return orders.order_state(spark, sf)


@query("SELECT o_orderkey AS order_id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS total, CASE WHEN o_orderstatus = 'F' THEN 'Cancelled' ELSE 'Pending' END AS status FROM orders")
def projection_order_totals(spark: SparkSession, sf: str) -> DataFrame:
    return orders.order_totals(order_log(spark, sf)).select("order_id", F.col("total").cast("double").alias("total"), "status")


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS r FROM orders),
    s AS (SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) FILTER (o_orderstatus <> 'F') AS open_orders,
        string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY r DESC) FILTER (r <= 5) AS recent_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS spent, count(*) AS order_count FROM o GROUP BY 1)
    SELECT coalesce(c_custkey, o_custkey) AS customer_id, c_name AS name, coalesce(open_orders, '') AS open_orders, coalesce(recent_orders, '') AS recent_orders, coalesce(spent, 0) AS spent, coalesce(order_count, 0) AS order_count
    FROM customer FULL JOIN s ON c_custkey = o_custkey""")
def projection_customer_orders(spark: SparkSession, sf: str) -> DataFrame:
    return orders.customer_orders(order_log(spark, sf))


@query(f"WITH {A} SELECT position, last_value(CASE WHEN name = 'signup' THEN k END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS owner FROM a")
def asof_owner_lookup(spark: SparkSession, sf: str) -> DataFrame:
    a = activity_log(spark, sf)
    return log.as_of(a.select("position", "user_id", "name", "k"), "user_id", F.when(F.col("name") == "signup", F.col("k")), "owner").select("position", "owner")


@query("""SELECT o_orderkey AS order_id, CASE WHEN o_orderstatus = 'F' THEN 'cancelled' WHEN n > 0 AND o_orderstatus = 'O' THEN 'shipped' WHEN n > 0 THEN 'prepared' ELSE 'requested' END AS state, coalesce(n, 0) AS n_events
    FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey""")
def process_fulfilment_state(spark: SparkSession, sf: str) -> DataFrame:
    return orders.fulfilment(spark, sf)


@query("SELECT o_orderkey AS order_id, CAST(epoch_us(o_orderdate + INTERVAL 6 HOUR) AS BIGINT) AS due_us FROM orders WHERE o_orderstatus = 'P' AND o_orderdate + INTERVAL 6 HOUR <= TIMESTAMP '1998-01-01'")
def process_timers_due(spark: SparkSession, sf: str) -> DataFrame:
    return orders.timers_due(spark, sf, "1998-01-01 00:00:00")


# ---- writes and administration -----------------------------------------------------------------------------------


@query(f"WITH {A} SELECT 'key-' || k AS key, min(position) AS first_position, count(*) - 1 AS refused FROM a GROUP BY 1")
def idempotent_dedup(spark: SparkSession, sf: str) -> DataFrame:
    keyed = activity_log(spark, sf).select("position", F.concat(F.lit("key-"), F.col("k").cast("string")).alias("key"))
    return log.first_of_key(keyed, "key")


#: What the events of two families must look like to be appended.
SALES = """
layer domain
context Activity {
  value Sale { amount: decimal, k: int } rules { Small: k < 95, Paid: amount > 20 }
  event purchase v1 { user_id: int, sale: Sale, tags: set<int>, note: string? }
  event click v1 { user_id: int, k: int = 3 }
  aggregate User { key user_id: int stream "user-{user_id}" events purchase, click }
}
"""


@query(f"""WITH {A}, s AS (SELECT position, name, user_id, k, CAST(value AS VARCHAR) AS v, value, CASE WHEN k % 13 = 0 THEN 'user-x' ELSE stream_id END AS stream, list_sort([k % 3, 9, k % 5]) AS tags FROM a),
    e AS (SELECT *, CASE WHEN name = 'purchase' THEN concat_ws('; ', CASE WHEN k >= 95 THEN '$.sale: violates Small' END, CASE WHEN value <= 20 THEN '$.sale: violates Paid' END, CASE WHEN k % 3 = k % 5 THEN '$.tags: duplicate element' END)
        WHEN name = 'click' THEN CASE WHEN k % 2 = 1 THEN '$.k: wrong type' ELSE '' END ELSE 'unknown event type' END AS field_errors FROM s),
    f AS (SELECT *, CASE WHEN field_errors <> '' THEN field_errors WHEN k % 13 = 0 THEN 'belongs to stream user-' || user_id ELSE '' END AS errors FROM e)
    SELECT position, errors, CASE WHEN errors = '' AND name = 'purchase' THEN '{{"user_id":' || user_id || ',"sale":{{"amount":"' || v || '","k":' || k || '}},"tags":[' || array_to_string(tags, ',') || '],"note":null}}'
        WHEN errors = '' THEN '{{"user_id":' || user_id || ',"k":3}}' END AS canonical FROM f""")
def prepare_event_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """Events as clients send them: accepted ones with their canonical payload, the others with what is wrong."""
    k, user = F.col("k").cast("string"), F.col("user_id").cast("string")
    sale = F.concat(F.lit('{"tags": ['), (F.col("k") % 3).cast("string"), F.lit(", 9, "), (F.col("k") % 5).cast("string"), F.lit('], "sale": {"k": '), k, F.lit(', "amount": "'), F.col("value").cast("string"), F.lit('"}, "user_id": '), user, F.lit("}"))
    click = F.concat(F.lit('{"user_id": '), user, F.when(F.col("k") % 2 == 1, ', "k": "one"}').otherwise("}"))
    rows = activity_log(spark, sf).select("position", F.when(F.col("k") % 13 == 0, "user-x").otherwise(F.col("stream_id")).alias("stream_id"), F.concat(F.lit("Activity."), "name").alias("type_ref"), F.when(F.col("name") == "purchase", sale).otherwise(click).alias("payload"), F.lit("{}").alias("metadata"))
    return validate.prepared(parse(SALES), rows).select("position", F.array_join("errors", "; ").alias("errors"), "canonical")


_MODES = "['any', 'no_stream', 'stream_exists', 'exact']"


@query(f"""WITH {A}, h AS (SELECT stream_id, count(*) - 1 AS actual FROM a GROUP BY 1),
    p AS (SELECT 'user-' || c_custkey AS stream_id, {_MODES}[c_custkey % 4 + 1] AS mode, c_custkey % 70 AS expected FROM customer)
    SELECT p.stream_id, mode, expected, actual, CASE WHEN mode = 'any' OR mode = 'no_stream' AND actual IS NULL OR mode = 'stream_exists' AND actual IS NOT NULL OR mode = 'exact' AND coalesce(actual = expected, false) THEN 'ok' ELSE 'wrong_expected_version' END AS outcome
    FROM p LEFT JOIN h ON p.stream_id = h.stream_id""")
def occ_conflicts(spark: SparkSession, sf: str) -> DataFrame:
    key = F.col("c_custkey")
    modes = F.array(*map(F.lit, ("any", "no_stream", "stream_exists", "exact")))
    wanted = table(spark, sf, "customer").select(F.concat(F.lit("user-"), key.cast("string")).alias("stream_id"), modes[(key % 4).cast("int")].alias("mode"), (key % 70).alias("expected"))
    return log.expected_version(wanted, log.stream_heads(activity_log(spark, sf)))


@query("""WITH RECURSIVE o AS (SELECT o_orderkey, o_custkey, o_orderstatus <> 'F' AS is_open, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders),
    r AS (SELECT o_orderkey, o_custkey, n, CAST(0 AS BIGINT) AS open, CAST(is_open AS INT) AS opens FROM o WHERE n = 1
      UNION ALL SELECT o.o_orderkey, o.o_custkey, o.n, r.open + r.opens, CAST(o.is_open AND r.open + r.opens < 5 AS INT) FROM r JOIN o ON o.o_custkey = r.o_custkey AND o.n = r.n + 1)
    SELECT o_orderkey AS order_id, open AS open_before, CASE WHEN open >= 5 THEN 'MAX_OPEN_ORDERS' ELSE 'accepted' END AS outcome FROM r""")
def invariant_max_open(spark: SparkSession, sf: str) -> DataFrame:
    """A customer has at most five open orders; a rejected order appends nothing, so it is not open.

    Orders are accepted until five are open and none closes here, so the open ones are the first five that would be.
    """
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), "o_custkey", "o_orderdate", "o_orderstatus")
    is_open = F.when(F.col("o_orderstatus") != "F", F.lit(1).cast("long"))
    rows = running(o, ["o_custkey"], ["o_orderdate", "order_id"], F.trunc("o_orderdate", "month"), sums={"before": is_open}, before=True)
    rows = rows.select("order_id", F.least("before", F.lit(5)).cast("long").alias("open_before"))
    return rows.select("*", F.when(F.col("open_before") >= 5, "MAX_OPEN_ORDERS").otherwise("accepted").alias("outcome"))


@query("SELECT coalesce(min(event_id) FILTER (ts > TIMESTAMP '2024-01-03'), max(event_id) + 1) AS cut FROM events")
def pit_cut_by_time(spark: SparkSession, sf: str) -> DataFrame:
    return log.position_after(activity_log(spark, sf), F.lit("2024-01-03 00:00:00").cast("timestamp_ntz"))


@query(f"WITH {A} SELECT stream_id, count(*) - 1 AS last_version, max(position) AS last_position, arg_max(family, position) AS last_family FROM a WHERE position < 400 GROUP BY stream_id")
def truncate_stream_heads(spark: SparkSession, sf: str) -> DataFrame:
    return log.stream_heads(log.truncate(activity_log(spark, sf), 400))


@query(f"WITH {A} SELECT position, stream_id, family, k FROM a WHERE position >= 300 AND position < 700")
def incremental_backup_range(spark: SparkSession, sf: str) -> DataFrame:
    return log.increment(activity_log(spark, sf), 300, 700).select("position", "stream_id", "family", "k")


@query(f"WITH {A}, b AS (SELECT CAST(floor(position / 7) AS BIGINT) AS b, min(position) AS lo, max(position) AS hi, count(*) AS n FROM a GROUP BY 1) SELECT CAST(floor(lo / 256) AS BIGINT) AS chunk, min(lo) AS first_position, max(hi) AS last_position, CAST(sum(n) AS BIGINT) AS n_events FROM b GROUP BY 1")
def replication_chunk_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return log.chunk_bounds(activity_log(spark, sf), F.floor(F.col("position") / 7), 256)


@query(f"WITH {A} SELECT user_id, CAST(sum(value) AS DOUBLE) AS total, count(*) AS n, max(position) AS last_position FROM a GROUP BY user_id")
def snapshot_plus_replay_equals_full(spark: SparkSession, sf: str) -> DataFrame:
    """State at a snapshot joined with the fold of the later events: the fold of all."""
    a = activity_log(spark, sf)
    state = lambda df: df.groupBy("user_id").agg(F.sum("value").alias("total"), F.count(F.lit(1)).alias("n"), F.max("position").alias("last_position"))
    both = state(a.where("position < 500")).unionByName(state(a.where("position >= 500")))
    return both.groupBy("user_id").agg(F.sum("total").cast("double").alias("total"), F.sum("n").alias("n"), F.max("last_position").alias("last_position"))


#: The events table's payloads, {"k": n}, in two versions: the second calls k an amount and adds a note.
ACTIVITY = """
layer domain
context Activity {
  event purchase v1 { k: int }
  event purchase v2 { k: int, note: string } upcast from v1 { set note: "legacy" }
  event purchase v3 { amount: int, note: string = "none", currency: string = "EUR" } upcast from v2 { rename k as amount }
}
"""


@query(f"WITH {A} SELECT position, k AS amount, CASE WHEN type_version = 1 THEN 'legacy' ELSE 'none' END AS note, 'EUR' AS currency FROM a WHERE family = 'Activity.purchase'")
def typed_view_purchase(spark: SparkSession, sf: str) -> DataFrame:
    """Events of every version as columns of the latest: one scan, no Python."""
    view = upcasts.typed_view(activity_log(spark, sf), parse(ACTIVITY), "Activity.purchase")
    return view.select("position", "event.amount", "event.note", "event.currency")


@query(f"WITH {A} SELECT position, to_hex(encode(name)) || '00' || printf('%016X', CAST(k AS HUGEINT) - 50 + 9223372036854775808) AS key_hex FROM a")
def key_encoding(spark: SparkSession, sf: str) -> DataFrame:
    """Compound keys as bytes that sort like (name, k - 50)."""
    key = F.concat(values.key_bytes("string", F.col("name")), values.key_bytes("int", F.col("k") - 50))
    return activity_log(spark, sf).select("position", F.hex(key).alias("key_hex"))


def _basket(event: dict, get_row) -> list[mutations.Row]:
    row, key = get_row((event["user_id"],)), (event["user_id"],)
    if event["name"] == "error":
        # what the row holds decides: an empty basket is removed
        return [mutations.Row(key).delete() if row is None or not row["items"] else mutations.Row(key).truncate_back("items", len(row["items"]) - 1)]
    return [mutations.Row(key).push("items", event["k"]).add("pushed", 1)] if event["name"] == "purchase" else []


@query(f"""WITH RECURSIVE {A}, o AS (SELECT user_id, k, name, row_number() OVER (PARTITION BY user_id ORDER BY position) AS n FROM a WHERE name IN ('error', 'purchase')),
    f AS (SELECT user_id, CAST(0 AS BIGINT) AS n, CAST(NULL AS BIGINT[]) AS l, CAST(0 AS BIGINT) AS c FROM o WHERE n = 1
      UNION ALL SELECT f.user_id, f.n + 1, CASE WHEN o.name = 'purchase' THEN list_append(coalesce(f.l, CAST([] AS BIGINT[])), o.k) WHEN len(coalesce(f.l, CAST([] AS BIGINT[]))) = 0 THEN NULL ELSE f.l[2:] END,
        CASE WHEN o.name = 'purchase' THEN f.c + 1 WHEN len(coalesce(f.l, CAST([] AS BIGINT[]))) = 0 THEN 0 ELSE f.c END FROM f JOIN o ON o.user_id = f.user_id AND o.n = f.n + 1),
    g AS (SELECT user_id, arg_max({{'l': l, 'c': c}}, n) AS s FROM f GROUP BY user_id)
    SELECT user_id, array_to_string(s.l, ',') AS items, s.c AS pushed FROM g WHERE s.l IS NOT NULL""")
def project_with_get_row(spark: SparkSession, sf: str) -> DataFrame:
    """A projection step in Python that reads the row it changes: scopes in parallel, events of a scope in order."""
    log_ = activity_log(spark, sf).where(F.col("name").isin("error", "purchase")).select("position", "user_id", "name", "k")
    rows = mutations.project(log_, F.col("user_id"), _basket, ["user_id"], {"items": "list", "pushed": "number"}, "user_id bigint, items array<bigint>, pushed bigint")
    return rows.select("user_id", F.array_join(F.col("items").cast("array<string>"), ",").alias("items"), "pushed")


@query("SELECT o_orderkey AS order_id, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DOUBLE) AS total, CASE WHEN o_orderstatus = 'F' THEN 'Cancelled' ELSE 'Pending' END AS status FROM orders WHERE o_orderkey = 42")
def query_get(spark: SparkSession, sf: str) -> DataFrame:
    return log.get(projection_order_totals(spark, sf), order_id=42)


@query(f"WITH {A}, m AS (SELECT user_id, name, count(*) AS n FROM a GROUP BY ALL) SELECT user_id, name, n FROM m WHERE user_id = 4 ORDER BY user_id, name LIMIT 3")
def query_scan_prefix(spark: SparkSession, sf: str) -> DataFrame:
    model = activity_log(spark, sf).groupBy("user_id", "name").agg(F.count(F.lit(1)).alias("n"))
    return log.scan(model, ["user_id", "name"], {"user_id": 4}, 3)
