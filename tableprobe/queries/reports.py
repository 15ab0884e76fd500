"""Queries for the report tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import column_groups
from tableprobe.operators.categorical import distinct_counts, entropies, value_counts, with_cardinality
from tableprobe.operators.evaluation import top_importances
from tableprobe.plans import report
from tableprobe.plans.fleet import analyse
from tableprobe.plans.profile import profile
from tableprobe.plans.rules import default_rules
from tableprobe.queries.registry import Tables, query, r, union_all
from tableprobe.queries.service import order_flags, rules_table
from tableprobe.queries.statistics import documents_with_labels, histogram_sql, top_sql


def _columns(df: DataFrame) -> DataFrame:
    """Column rows as the chart tables need them."""
    groups = column_groups(df)
    kinds = [(c, k, df.columns.index(c)) for k, names in groups.items() for c in names]
    base = df.sparkSession.createDataFrame(kinds, "column string, kind string, position int")
    ratios = with_cardinality(entropies(distinct_counts(df, groups["categorical"])), df.count()).select("column", "cardinality_ratio")
    return base.join(ratios, "column", "left")


@query(
    "chart_histograms",
    "P1 M2",
    f"SELECT \"column\", bin, n, bin_center FROM ({union_all([histogram_sql(c, 'lineitem') for c in ('l_orderkey', 'l_partkey', 'l_suppkey', 'l_linenumber', 'l_quantity', 'l_extendedprice', 'l_discount', 'l_tax')])})",
)
def chart_histograms(t: Tables) -> DataFrame:
    """Histograms of the first ten numeric columns in table order; this table has eight."""
    from tableprobe.operators.distribution import histograms

    df = t.lineitem
    named = _columns(df).withColumn("dataset", F.lit("lineitem"))
    bars = histograms(df, column_groups(df)["numeric"]).withColumn("dataset", F.lit("lineitem"))
    return report.numeric_charts(bars, named).select("column", "bin", "n", "bin_center")


@query(
    "chart_categories",
    "P1 T8 M11",
    f"""SELECT "column", rank, value, n FROM ({top_sql("p_brand", "part", 15)}) UNION ALL SELECT 'p_brand', 16, 'other (' || max(other_count) || ')', max(other_count) FROM ({top_sql("p_brand", "part", 15)}) HAVING max(other_count) > 0
    UNION ALL SELECT "column", rank, value, n FROM ({top_sql("p_type", "part", 15)})
    UNION ALL SELECT * FROM (SELECT 'p_name', 0, 'distinct', count(DISTINCT p_name) FROM part) WHERE (SELECT count(DISTINCT p_name) >= 30 FROM part)""",
)
def chart_categories(t: Tables) -> DataFrame:
    """Bars per category column; an id-like one is a single line with its distinct count."""
    df = t.part
    columns = _columns(df)
    bars, lines = report.category_charts(value_counts(df, ["p_name", "p_brand", "p_type"]), columns, F.lit(df.count()))
    one_line = lines.select("column", F.lit(0).alias("rank"), F.lit("distinct").alias("value"), F.col("n_unique").alias("n"))
    return bars.select("column", "rank", "value", "n").unionByName(one_line)


@query("target_chart", "P2", "SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1")
def target_chart(t: Tables) -> DataFrame:
    from tableprobe.operators.target import class_counts

    return report.target_chart(class_counts(t.events, "event_type"))


@query(
    "report_summary",
    "P3 M13 A23",
    f"""WITH d AS (SELECT doc_id, text, lang, source, n_chars, quality, toxic FROM documents LEFT JOIN labels USING (doc_id))
    SELECT 'labelled' AS dataset, count(*) AS n_rows, 7::BIGINT AS n_cols, {r('(14.0 / 7) * (1 - count(quality) / count(*)) / 2 * 2 / 7')} AS total_missing_pct,
    {r('1 - count(quality) / count(*)')} AS max_col_missing_pct, 0.0::DOUBLE AS duplicate_rows_pct, 'categorical' AS target_kind, count(DISTINCT quality) AS target_n_unique,
    (2.0 / 7) * (1 - count(quality) / count(*)) > 0.1 AS mark_missing, false AS mark_duplicates FROM d""",
)
def report_summary(t: Tables) -> DataFrame:
    found = profile(documents_with_labels(t), "labelled", "quality")
    return report.summary(found.table).drop("target_imbalance_ratio", "target_class_entropy", "target_skewness")


@query(
    "importance_bars",
    "M13 T10",
    f"""SELECT c AS feature, n::DOUBLE AS importance, {r('100 * n / max(n) OVER ()')} AS width_pct FROM (
    SELECT p_brand AS c, count(*) AS n FROM part GROUP BY 1 ORDER BY n DESC, c LIMIT 10)""",
)
def importance_bars(t: Tables) -> DataFrame:
    """Bar widths in percent of the largest, for the ten largest."""
    counted = t.part.groupBy(F.col("p_brand").alias("feature")).agg(F.count(F.lit(1)).cast("double").alias("importance"))
    return top_importances(counted)


@query(
    "result_flags",
    "P5 T2 J1",
    """SELECT o_custkey AS dataset, count(*) AS n_flags, CASE WHEN bool_or(o_orderpriority IN ('1-URGENT', '2-HIGH')) THEN 'critical' WHEN bool_or(o_orderpriority = '3-MEDIUM') THEN 'warning' ELSE 'info' END AS worst
    FROM orders WHERE o_orderpriority <> '4-NOT SPECIFIED' GROUP BY 1""",
)
def result_flags(t: Tables) -> DataFrame:
    """Result rows with their flags, worst first, counted per result."""
    flags = order_flags(t).join(rules_table(t), "rule_code").select(
        F.col("dataset_id").alias("dataset"), "rule_code", F.lit(None).cast("string").alias("column"), "severity", F.lit("").alias("message")
    )
    rows = report.result_page(flags.select("dataset").distinct(), flags)
    return rows.groupBy("dataset").agg(F.count("rule_code").alias("n_flags"), F.min_by("severity", "severity_rank").alias("worst"))


@query("whole_run", "P7 P5 A23")
def whole_run(t: Tables) -> DataFrame:
    """Profile, flags, recommendation; the vector fails without a scale and is noted."""
    run = analyse(t.orders, "orders", default_rules(t.spark), "o_orderstatus", "o_orderkey")
    advice = run.result.select(F.lit("advice").alias("part"), F.col("task_type_code").alias("name"), F.col("explanation").alias("value"))
    flags = run.flags.select(F.lit("flag").alias("part"), F.col("rule_code").alias("name"), F.col("message").alias("value"))
    errors = run.errors.select(F.lit("error").alias("part"), F.col("step").alias("name"), F.col("error").alias("value"))
    return advice.unionByName(flags).unionByName(errors)
