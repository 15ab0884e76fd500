"""Queries for the joins, pages, counts and set operations of the service tables.

customer stands for the users, orders for their runs, lineitem for what hangs off a run.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tableprobe.functions.scalars import duration_seconds, duration_text, shorten
from tableprobe.operators import service
from tableprobe.plans.catalog import load_catalog
from tableprobe.plans.report import history
from tableprobe.plans.rules import RULES, default_rules, seed_rules
from tableprobe.queries.registry import Tables, query, r

# A flag per order: its priority names the rule, so that flags grow with the data.
_CODES = {"1-URGENT": "TARGET_MISSING", "2-HIGH": "LEAKAGE_SUSPICION", "3-MEDIUM": "HIGH_MISSING", "4-NOT SPECIFIED": "NO_SUCH_RULE", "5-LOW": "OUTLIERS"}
_RULES_SQL = "(VALUES " + ", ".join(f"('{c}', '{n}', '{s}')" for c, n, s, _ in RULES) + ") rules(rule_code, rule_name, severity)"
_FLAGS_SQL = (
    "(SELECT o_orderkey AS flag_id, o_custkey AS dataset_id, CASE o_orderpriority "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _CODES.items())
    + " END AS rule_code, o_orderdate AS created_at FROM orders)"
)
_RANK_SQL = "CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 WHEN 'info' THEN 2 ELSE 3 END"


def order_flags(t: Tables) -> DataFrame:
    codes = F.create_map(*[F.lit(x) for kv in _CODES.items() for x in kv])
    return t.orders.select(
        F.col("o_orderkey").alias("flag_id"),
        F.col("o_custkey").alias("dataset_id"),
        codes[F.col("o_orderpriority")].alias("rule_code"),
        F.col("o_orderdate").alias("created_at"),
    )


def rules_table(t: Tables) -> DataFrame:
    return F.broadcast(default_rules(t.spark).select("rule_code", "rule_name", "severity"))  # a dozen rows


@query("flags_with_rules", "J1", f"SELECT flag_id, dataset_id, rule_code, rule_name, severity FROM {_FLAGS_SQL} JOIN {_RULES_SQL} USING (rule_code)")
def flags_with_rules(t: Tables) -> DataFrame:
    return order_flags(t).join(rules_table(t), "rule_code").select("flag_id", "dataset_id", "rule_code", "rule_name", "severity")


@query("leakage_flags", "J2", f"SELECT DISTINCT dataset_id FROM {_FLAGS_SQL} JOIN {_RULES_SQL} USING (rule_code) WHERE rule_code = 'LEAKAGE_SUSPICION'")
def leakage_flags(t: Tables) -> DataFrame:
    joined = order_flags(t).join(rules_table(t), "rule_code")
    return joined.where(F.col("rule_code") == "LEAKAGE_SUSPICION").select("dataset_id").distinct()


_LEFT = """SELECT o_orderkey, c_name, n_lines FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment <> 'BUILDING') ON c_custkey = o_custkey
LEFT JOIN (SELECT l_orderkey, count(*) AS n_lines FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey"""


@query("runs_with_optional_results", "J3", _LEFT)
def runs_with_optional_results(t: Tables) -> DataFrame:
    owners = t.customer.where("c_mktsegment <> 'BUILDING'")
    results = t.lineitem.where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n_lines"))
    joined = t.orders.join(owners, F.col("o_custkey") == F.col("c_custkey"), "left").join(
        results, F.col("o_orderkey") == F.col("l_orderkey"), "left"
    )
    return joined.select("o_orderkey", "c_name", "n_lines")


@query(
    "flags_with_default_rule",
    "J4",
    f"""SELECT flag_id, coalesce(rule_name, '—') AS rule_name, coalesce(severity, 'info') AS severity, coalesce(known, 'UNKNOWN') AS code
    FROM {_FLAGS_SQL} f LEFT JOIN (SELECT *, rule_code AS known FROM {_RULES_SQL}) USING (rule_code)""",
)
def flags_with_default_rule(t: Tables) -> DataFrame:
    lookup = rules_table(t).withColumn("code", F.col("rule_code"))
    found = service.with_lookup(order_flags(t), lookup, "rule_code", {"rule_name": "—", "severity": "info", "code": "UNKNOWN"})
    return found.select("flag_id", "rule_name", "severity", "code")


@query(
    "owner_child_counts",
    "J5",
    """SELECT c_custkey, c_name, coalesce(n_orders, 0)::BIGINT AS n_orders, coalesce(n_done, 0)::BIGINT AS n_done FROM customer
    LEFT JOIN (SELECT o_custkey, count(*) AS n_orders FROM orders GROUP BY 1) a ON a.o_custkey = c_custkey
    LEFT JOIN (SELECT o_custkey, count(*) AS n_done FROM orders WHERE o_orderstatus = 'F' GROUP BY 1) b ON b.o_custkey = c_custkey""",
)
def owner_child_counts(t: Tables) -> DataFrame:
    children = {"n_orders": (t.orders, "o_custkey"), "n_done": (t.orders.where("o_orderstatus = 'F'"), "o_custkey")}
    return service.with_child_counts(t.customer.select("c_custkey", "c_name"), "c_custkey", children)


def _catalog(t: Tables) -> tuple[DataFrame, DataFrame]:
    p = t.part
    old = p.where("p_size <= 30").select(
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("title"), F.col("p_type").alias("tags"),
        F.col("p_size").cast("long").alias("n_rows"), F.lit(True).alias("is_active"),
    )
    new = p.where("p_size > 20").select(
        F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")).alias("title"), F.lower("p_type").alias("tags"),
        (F.col("p_size") * 100).cast("long").alias("n_rows"), (F.col("p_size") < 40).alias("is_active"),
    )
    return old, new


_OLD = "(SELECT p_name || ' ' || p_partkey AS title, p_type AS tags, p_size::BIGINT AS n_rows, true AS is_active FROM part WHERE p_size <= 30)"
_NEW = "(SELECT p_name || ' ' || p_partkey AS title, lower(p_type) AS tags, p_size::BIGINT * 100 AS n_rows, p_size < 40 AS is_active FROM part WHERE p_size > 20)"


@query(
    "catalog_merge",
    "J7",
    f"""SELECT coalesce(o.title, n.title) AS title, coalesce(o.tags, n.tags) AS tags, coalesce(n.n_rows, o.n_rows) AS n_rows,
    coalesce(n.is_active, o.is_active) AS is_active FROM {_OLD} o FULL JOIN {_NEW} n ON o.title = n.title""",
)
def catalog_merge(t: Tables) -> DataFrame:
    """New titles come in whole; known ones change only their mutable fields."""
    return load_catalog(*_catalog(t))


@query("insert_if_absent", "J8 U3", f"SELECT * FROM {_OLD} UNION ALL SELECT * FROM {_NEW} n WHERE n.title NOT IN (SELECT title FROM {_OLD})")
def insert_if_absent(t: Tables) -> DataFrame:
    return service.insert_absent(*_catalog(t), "title")


@query(
    "seeded_rules",
    "J8 U3",
    f"""SELECT rule_code, CASE WHEN rule_code IN (SELECT rule_code FROM {_FLAGS_SQL}) THEN 'kept' ELSE 'seeded' END AS origin FROM {_RULES_SQL}
    UNION ALL SELECT 'NO_SUCH_RULE', 'kept'""",
)
def seeded_rules(t: Tables) -> DataFrame:
    """Stored rules are kept as they are, the missing ones are added."""
    stored = order_flags(t).select("rule_code").distinct().select(
        "rule_code", F.lit("kept").alias("rule_name"), F.lit("info").alias("severity"),
        F.lit(None).cast("map<string,double>").alias("thresholds"), F.lit(False).alias("is_active"),
    )
    return seed_rules(stored).select("rule_code", F.when(F.col("rule_name") == "kept", "kept").otherwise("seeded").alias("origin"))


@query(
    "purge_owner",
    "J9",
    """SELECT 'orders' AS "table", count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')
    UNION ALL SELECT 'lineitem', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders
      WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY'))""",
)
def purge_owner(t: Tables) -> DataFrame:
    """Removing owners removes their runs and what hangs off those."""
    gone = t.customer.where("c_mktsegment = 'MACHINERY'").select("c_custkey")
    lost_runs = service.among(t.orders, "o_custkey", gone).select("o_orderkey")
    left = service.purge({"orders": (t.orders, "o_custkey")}, gone)
    left |= service.purge({"lineitem": (t.lineitem, "l_orderkey")}, lost_runs)
    parts = [df.agg(F.lit(n).alias("table"), F.count(F.lit(1)).alias("n")) for n, df in left.items()]
    return parts[0].unionByName(parts[1])


@query(
    "run_page",
    "T1",
    "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 20 OFFSET 40",
)
def run_page(t: Tables) -> DataFrame:
    kept = service.matching(t.orders, o_orderstatus="O")
    return service.page(kept, [F.desc("o_orderdate"), F.asc("o_orderkey")], 3, 20).select("o_orderkey", "o_orderstatus")


@query(
    "page_totals",
    "T1 A25",
    """SELECT 'runs' AS list, count(*) AS total, ceil(count(*) / 20)::BIGINT AS pages FROM orders WHERE o_orderstatus = 'O'
    UNION ALL SELECT 'none', 0, 0 UNION ALL SELECT 'admin none', 0, 1""",
)
def page_totals(t: Tables) -> DataFrame:
    none = service.matching(t.orders, o_orderstatus="no such status")
    parts = [
        service.page_totals(service.matching(t.orders, o_orderstatus="O"), 20).withColumn("list", F.lit("runs")),
        service.page_totals(none, 20).withColumn("list", F.lit("none")),
        service.page_totals(none, 20, at_least=1).withColumn("list", F.lit("admin none")),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "flags_by_severity",
    "T2 A32",
    f"SELECT severity, {_RANK_SQL} AS rank, count(*) AS n_flags FROM {_FLAGS_SQL} JOIN {_RULES_SQL} USING (rule_code) GROUP BY ALL",
)
def flags_by_severity(t: Tables) -> DataFrame:
    joined = order_flags(t).join(rules_table(t), "rule_code")
    return service.by_severity(joined).withColumn("rank", service.severity_rank(F.col("severity")))


@query(
    "flags_in_order",
    "T2",
    f"""SELECT flag_id, severity, row_number() OVER (PARTITION BY severity ORDER BY created_at, flag_id) AS place FROM {_FLAGS_SQL} JOIN {_RULES_SQL} USING (rule_code)""",
)
def flags_in_order(t: Tables) -> DataFrame:
    """All flags, worst severity first, then the older one, with their place in their severity."""
    joined = order_flags(t).join(rules_table(t), "rule_code")
    place = F.row_number().over(Window.partitionBy("severity").orderBy("created_at", "flag_id")).cast("long")
    order = [service.severity_rank(F.col("severity")), F.asc("created_at"), F.asc("flag_id")]
    return joined.withColumn("place", place).orderBy(*order).select("flag_id", "severity", "place")


@query(
    "latest_open_run",
    "T3",
    """SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
    FROM orders WHERE o_orderstatus IN ('O', 'P')) WHERE rn = 1""",
)
def latest_open_run(t: Tables) -> DataFrame:
    active = service.among(t.orders, "o_orderstatus", ["O", "P"])
    return service.latest(active, "o_custkey", [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey")


@query(
    "service_counts",
    "A24",
    f"""SELECT 'orders' AS "table", count(*) AS total, count(*) FILTER (o_orderstatus = 'F') AS done, {r("count(*) FILTER (o_orderstatus = 'F') / count(*)")} AS success_rate FROM orders
    UNION ALL SELECT 'none', 0, 0, NULL""",
)
def service_counts(t: Tables) -> DataFrame:
    done = F.col("o_orderstatus") == "F"
    some = service.success_counts(t.orders, done).withColumn("table", F.lit("orders"))
    none = service.success_counts(t.orders.where("o_orderstatus = 'X'"), done).withColumn("table", F.lit("none"))
    return some.unionByName(none)


@query(
    "union_with_missing_fields",
    "U1",
    "SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment FROM customer UNION ALL SELECT s_name, s_acctbal, NULL FROM supplier",
)
def union_with_missing_fields(t: Tables) -> DataFrame:
    a = t.customer.select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"))
    b = t.supplier.select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return a.unionByName(b, allowMissingColumns=True)


@query("fired_rules", "U2", f"SELECT DISTINCT rule_code FROM {_FLAGS_SQL}")
def fired_rules(t: Tables) -> DataFrame:
    return order_flags(t).select("rule_code").distinct()


@query(
    "run_durations",
    "X4",
    """SELECT o_orderkey, s AS seconds, CASE WHEN s IS NULL THEN NULL WHEN s < 60 THEN s || ' s' WHEN s % 60 = 0 THEN (s // 60) || ' min' ELSE (s // 60) || ' min ' || (s % 60) || ' s' END AS duration
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN greatest(0, o_custkey - 20)::BIGINT END AS s FROM orders)""",
)
def run_durations(t: Tables) -> DataFrame:
    started = F.col("o_orderdate").cast("timestamp")
    finished = F.when(F.col("o_orderstatus") != "P", F.timestamp_add("SECOND", (F.col("o_custkey") - 20).cast("int"), started))
    seconds = duration_seconds(started, finished)
    return t.orders.select("o_orderkey", seconds.alias("seconds")).withColumn("duration", duration_text(F.col("seconds")))


@query("json_lookup", "X5", "SELECT event_id, (props->>'$.k')::BIGINT AS k, props->>'$.missing' AS missing FROM events")
def json_lookup(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.get_json_object("props", "$.missing").alias("missing"),
    )


@query("shortened_texts", "X11", "SELECT conv_id, turn, CASE WHEN length(text) > 60 THEN rtrim(left(text, 60), ' ') || '…' ELSE text END AS short FROM conversations")
def shortened_texts(t: Tables) -> DataFrame:
    return t.conversations.select("conv_id", "turn", shorten(F.col("text"), 60).alias("short"))


@query(
    "history_page",
    "P6 J3 X5 T1",
    """SELECT o_orderkey AS analysis_id, c_name AS dataset_name, task FROM orders LEFT JOIN customer ON c_custkey = o_custkey
    LEFT JOIN (SELECT event_id AS ek, props->>'$.k' AS task FROM events) ON ek = o_orderkey
    ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50""",
)
def history_page(t: Tables) -> DataFrame:
    runs = t.orders.select(F.col("o_orderkey").alias("analysis_id"), F.col("o_custkey").alias("dataset_id"), F.col("o_orderdate").alias("started_at"))
    names = t.customer.select(F.col("c_custkey").alias("dataset_id"), F.col("c_name").alias("dataset_name"))
    results = t.events.select(F.col("event_id").alias("analysis_id"), F.get_json_object("props", "$.k").alias("task"))
    return history(runs, names, results, 2, 50).select("analysis_id", "dataset_name", "task")
