"""Queries for the quality rules and the task recommendation."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import column_groups
from tableprobe.functions.dates import date_share, is_date, parsed_date
from tableprobe.operators import categorical, numeric, relation, structure
from tableprobe.operators import target as target_ops
from tableprobe.operators.service import severity_rank
from tableprobe.plans import profile as profile_plan
from tableprobe.plans.quality import leakage_columns, quality_flags
from tableprobe.plans.recommend import CLUSTERING, RULE_TEXTS, TASK_NAMES, WARNING_TEXTS, applied_rules, decide, hybrid, with_warnings
from tableprobe.plans.rules import RULES, default_rules
from tableprobe.queries.registry import Tables, query, r, union_all
from tableprobe.queries.relations import mi_sql, r_of
from tableprobe.queries.statistics import _TARGETS, target_facts, target_sql
from tableprobe.session import together

THRESHOLDS = {k: v for _, _, _, limits in RULES for k, v in limits.items()}
SEVERITY = {code: severity for code, _, severity, _ in RULES}


@dataclass
class Audited:
    """A table derived from the given ones, in Spark and in SQL."""

    name: str
    build: object  # Tables -> DataFrame
    sql: str
    columns: dict[str, str]  # column → number, text or time
    target: str | None = None
    number_target: bool = False


def _priced(t: Tables) -> DataFrame:
    return t.lineitem.select(
        "l_extendedprice", "l_quantity", F.when(F.col("l_returnflag") == "R", F.col("l_discount")).alias("discount_r"),
        (F.col("l_extendedprice") * 2).alias("price_twice"), F.lit(7.0).alias("flat"),
        F.date_format("l_shipdate", "yyyy-MM-dd").alias("ship_day"), "l_returnflag", "l_linestatus",
    )


AUDITED = [
    Audited(
        "priced_lines", _priced,
        "(SELECT l_extendedprice, l_quantity, CASE WHEN l_returnflag = 'R' THEN l_discount END AS discount_r, l_extendedprice * 2 AS price_twice, "
        "7.0::DOUBLE AS flat, strftime(l_shipdate, '%Y-%m-%d') AS ship_day, l_returnflag, l_linestatus FROM lineitem)",
        {"l_extendedprice": "number", "l_quantity": "number", "discount_r": "number", "price_twice": "number", "flat": "number",
         "ship_day": "text", "l_returnflag": "text", "l_linestatus": "text"},
        "l_extendedprice", True,
    ),
    Audited(
        "labelled_documents", lambda t: t.documents.join(t.labels, "doc_id", "left").drop("quality"),
        "(SELECT doc_id, text, lang, source, n_chars, toxic FROM documents LEFT JOIN labels USING (doc_id))",
        {"doc_id": "number", "text": "text", "lang": "text", "source": "text", "n_chars": "number", "toxic": "number"},
        "toxic", True,
    ),
    Audited("texts", lambda t: t.documents.select("text", "lang"), "(SELECT text, lang FROM documents)", {"text": "text", "lang": "text"}),
    Audited(
        "suppliers", lambda t: t.supplier.select("s_suppkey", "s_name", "s_acctbal", F.concat(F.lit("N"), F.col("s_nationkey").cast("string")).alias("nation")),
        "(SELECT s_suppkey, s_name, s_acctbal, 'N' || s_nationkey AS nation FROM supplier)",
        {"s_suppkey": "number", "s_name": "text", "s_acctbal": "number", "nation": "text"}, "nation", False,
    ),
    Audited(
        "late_lines",
        lambda t: t.lineitem.select("l_quantity", "l_tax", "l_linestatus", "l_shipdate",
                                    ((F.col("l_linenumber") == 7) & (F.col("l_returnflag") == "A")).cast("int").alias("late")),
        "(SELECT l_quantity, l_tax, l_linestatus, l_shipdate, (l_linenumber = 7 AND l_returnflag = 'A')::INTEGER AS late FROM lineitem)",
        {"l_quantity": "number", "l_tax": "number", "l_linestatus": "text", "l_shipdate": "time", "late": "number"}, "late", True,
    ),
    Audited("regions", lambda t: t.region, "region", {"r_regionkey": "number", "r_name": "text"}),
    Audited(
        "event_values",
        lambda t: t.events.select("event_type", "user_id", "value", (F.col("value") * F.col("value")).alias("value_squared"),
                                  F.upper("event_type").alias("type_copy")),
        "(SELECT event_type, user_id, value, value * value AS value_squared, upper(event_type) AS type_copy FROM events)",
        {"event_type": "text", "user_id": "number", "value": "number", "value_squared": "number", "type_copy": "text"}, "event_type", False,
    ),
]
BY_NAME = {a.name: a for a in AUDITED}


def flags_sql(a: Audited, only: tuple[str, ...] | None = None) -> str:
    """All rules on one table in SQL: dataset, rule_code, column, method, value, threshold."""
    s, target = a.sql, a.target
    parts: list[str] = []

    def add(code, column, method, value, threshold, compare, source, extra="true"):
        if only is not None and code not in only:
            return
        limit = THRESHOLDS[threshold]
        parts.append(
            f"SELECT '{a.name}' AS dataset, '{code}' AS rule_code, {column} AS \"column\", '{method}' AS method, v AS value, {limit}::DOUBLE AS threshold "
            f"FROM (SELECT {value} AS v FROM {source}) WHERE v {compare} {limit} AND {extra}"
        )

    features = [c for c in a.columns if c != target]
    for c in a.columns:
        if c == target:
            add("TARGET_MISSING", f"'{c}'", "", f"1 - count({c}) / count(*)", "max_target_missing_pct", ">", s)
        else:
            add("HIGH_MISSING", f"'{c}'", "", f"1 - count({c}) / count(*)", "max_col_missing_pct", ">", s)
        if a.columns[c] == "text":
            add("DATE_NOT_PARSED", f"'{c}'", "", f"count(try_strptime({c}, '%Y-%m-%d')) / nullif(count({c}), 0)", "min_date_parse_rate", ">=", s)
    for c in features:
        if a.columns[c] == "number":
            add("LOW_VARIANCE", f"'{c}'", "numeric",
                f"CASE WHEN stddev_pop({c}::DOUBLE) = 0 THEN 0 ELSE stddev_pop({c}::DOUBLE) / abs(nullif(avg({c}::DOUBLE), 0)) END", "min_cv", "<", s)
            q = f"(SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {s})"
            add("OUTLIERS", f"'{c}'", "", f"count(*) FILTER ({c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)) / nullif(count({c}), 0)",
                "max_outliers_pct", ">", f"{s}, {q}")
        if a.columns[c] == "text":
            counts = f"(SELECT {c} AS v, count(*) AS n FROM {s} WHERE {c} IS NOT NULL GROUP BY 1)"
            add("LOW_VARIANCE", f"'{c}'", "categorical",
                "CASE WHEN count(*) <= 1 THEN 0.0 ELSE (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(count(*)) END", "min_normalized_entropy", "<", counts)
            add("HIGH_CARDINALITY", f"'{c}'", "", f"count(DISTINCT {c}) / count(*)", "max_cardinality_ratio", ">", s)
    rows = f"(SELECT count(*) AS n FROM {s} GROUP BY ALL)".replace("GROUP BY ALL", "GROUP BY " + ", ".join(a.columns))
    add("DUPLICATES", "NULL", "", "sum(n - 1) / sum(n)", "max_duplicates_pct", ">", rows)
    add("SMALL_DATASET", "NULL", "", "count(*)::DOUBLE", "min_rows", "<", s)
    if only is None or "TOO_FEW_FEATURES" in only:
        add("TOO_FEW_FEATURES", "NULL", "", f"{len(features)}::DOUBLE", "min_cols", "<", "(SELECT 1)")
    if target:
        counts = f"(SELECT {target} AS t, count(*) AS n FROM {s} WHERE {target} IS NOT NULL GROUP BY 1)"
        few = "count(*) <= greatest(20, floor(0.05 * sum(n)))" if a.number_target else "true"
        add("IMBALANCE_BINARY", f"'{target}'", "", f"CASE WHEN {few} AND count(*) = 2 THEN max(n) / min(n) END", "max_imbalance_ratio", ">", counts)
        add("IMBALANCE_MULTICLASS", f"'{target}'", "", f"CASE WHEN {few} AND count(*) >= 3 THEN min(n)::DOUBLE END", "min_class_size", "<", counts)
        if only is None or "LEAKAGE_SUSPICION" in only:
            by_r = [f"SELECT '{c}' AS c, abs({r_of(c + '::DOUBLE', target + '::DOUBLE')}) AS v FROM {s}" for c in features
                    if a.columns[c] == "number" and a.columns[target] == "number"] or ["SELECT '' AS c, NULL::DOUBLE AS v"]
            strong = f"(SELECT * FROM ({union_all(by_r)}) WHERE v > 0.95)"
            parts.append(f"SELECT '{a.name}', 'LEAKAGE_SUSPICION', c, 'pearson', v, 0.95::DOUBLE FROM {strong}")
            info = mi_sql(s, target, a.number_target, {c: a.columns[c] for c in features})
            parts.append(
                f"SELECT '{a.name}', 'LEAKAGE_SUSPICION', \"column\", 'mutual_information', mi, 0.9::DOUBLE FROM ({info}) "
                f"WHERE mi > 0.9 AND \"column\" NOT IN (SELECT c FROM {strong})"
            )
    head = "SELECT '' AS dataset, '' AS rule_code, '' AS \"column\", '' AS method, 0.0::DOUBLE AS value, 0.0::DOUBLE AS threshold WHERE false"
    return union_all([head, *parts])


def shown_sql(inner: str) -> str:
    severity = "CASE rule_code " + " ".join(f"WHEN '{c}' THEN '{s}'" for c, s in SEVERITY.items()) + " END"
    return f'SELECT dataset, rule_code, "column", method, {r("value")} AS value, threshold, {severity} AS severity FROM ({inner})'


SHOWN = ["dataset", "rule_code", "column", "method", "value", "threshold", "severity"]


@query("quality_flags", "Q1 Q2 Q3 Q4 Q5 Q6 Q7 Q8 Q9 Q10 Q11 Q12 A23 J1 T2", shown_sql(union_all([flags_sql(a) for a in AUDITED])))
def all_flags(t: Tables) -> DataFrame:
    """All twelve rules over full profiles of seven tables, worst severity first."""
    parts = together({a.name: (lambda a=a: flags_of(t, a)) for a in AUDITED}, at_once=4)
    flags = reduce(DataFrame.unionByName, parts.values())
    return flags.orderBy(severity_rank(F.col("severity")), "dataset", "rule_code", "column").select(*SHOWN)


def flags_of(t: Tables, a: Audited) -> DataFrame:
    found = profile_plan.profile(a.build(t), a.name, a.target)
    found.release()
    return quality_flags(found.table, found.columns, default_rules(t.spark))


# ---- one rule at a time, from the one statistic it needs ------------------------------

COLUMN_FIELDS = {
    "is_target": "boolean", "missing_pct": "double", "target_abs_r": "double", "target_mi": "double", "mean": "double", "std": "double",
    "normalized_entropy": "double", "cardinality_ratio": "double", "outliers_pct": "double", "date_share": "double",
}
TABLE_FIELDS = {
    "n_rows": "long", "original_rows": "long", "n_cols": "long", "target_column": "string", "target_kind": "string", "target_n_unique": "long",
    "target_imbalance_ratio": "double", "min_class_size": "long", "min_class": "string", "duplicate_rows_pct": "double",
}


def _with_fields(df: DataFrame, fields: dict[str, str]) -> DataFrame:
    for name, kind in fields.items():
        if name not in df.columns:
            df = df.withColumn(name, F.lit(None).cast(kind))
    return df


def judge(t: Tables, a: Audited, columns: DataFrame | None = None, table: DataFrame | None = None) -> DataFrame:
    """Apply the rules to partial statistics of one table."""
    spark = t.spark
    name = F.lit(a.name)
    columns = spark.createDataFrame([], "column string") if columns is None else columns
    columns = _with_fields(columns.withColumn("dataset", name), {})
    if "is_target" not in columns.columns:
        columns = columns.withColumn("is_target", F.col("column") == F.lit(a.target or ""))
    if table is None:  # sizes no rule objects to
        table = spark.createDataFrame([(10**9, 10**9, 10**6)], "n_rows long, original_rows long, n_cols long")
    elif "n_cols" not in table.columns:
        table = table.withColumn("n_cols", F.lit(10**6).cast("long"))
    table = table.withColumn("dataset", name)
    flags = quality_flags(_with_fields(table, TABLE_FIELDS), _with_fields(columns, COLUMN_FIELDS), default_rules(spark))
    return flags.select(*SHOWN)


def rule_sql(code: str, *names: str) -> str:
    return shown_sql(union_all([flags_sql(BY_NAME[n], (code,)) for n in names]))


def over(t: Tables, code: str, names: tuple[str, ...], columns=None, table=None) -> DataFrame:
    out = []
    for n in names:
        a = BY_NAME[n]
        df = a.build(t)
        flags = judge(t, a, columns(df, a) if columns else None, table(df, a) if table else None)
        out.append(flags.where(F.col("rule_code") == code))
    return reduce(DataFrame.unionByName, out)


@query("rule_target_missing", "Q1", rule_sql("TARGET_MISSING", "labelled_documents", "suppliers"))
def rule_target_missing(t: Tables) -> DataFrame:
    return over(t, "TARGET_MISSING", ("labelled_documents", "suppliers"), lambda df, a: structure.missing_by_column(df).drop("n_rows"))


def _relations(df: DataFrame, a: Audited) -> DataFrame:
    info = relation.mutual_information(df, a.target).withColumnRenamed("mi", "target_mi")
    numbers = column_groups(df)["numeric"]
    if a.target not in numbers:
        return info
    with_r = relation.target_correlations(relation.correlations(df, numbers), a.target).withColumnRenamed("abs_r", "target_abs_r")
    return info.join(with_r, "column", "left")


@query("rule_leakage", "Q2 U4", rule_sql("LEAKAGE_SUSPICION", "priced_lines", "event_values"))
def rule_leakage(t: Tables) -> DataFrame:
    """By correlation, and by information for columns not already flagged."""
    return over(t, "LEAKAGE_SUSPICION", ("priced_lines", "event_values"), _relations)


@query("leakage_columns", "J2 U4", f"SELECT DISTINCT \"column\" FROM ({rule_sql('LEAKAGE_SUSPICION', 'event_values')})")
def leakage_columns_query(t: Tables) -> DataFrame:
    return leakage_columns(over(t, "LEAKAGE_SUSPICION", ("event_values",), _relations), "event_values")


@query("rule_high_missing", "Q3", rule_sql("HIGH_MISSING", "priced_lines", "labelled_documents"))
def rule_high_missing(t: Tables) -> DataFrame:
    return over(t, "HIGH_MISSING", ("priced_lines", "labelled_documents"), lambda df, a: structure.missing_by_column(df).drop("n_rows"))


@query("rule_duplicates", "Q4", rule_sql("DUPLICATES", "texts", "suppliers"))
def rule_duplicates(t: Tables) -> DataFrame:
    return over(t, "DUPLICATES", ("texts", "suppliers"), table=lambda df, a: structure.duplicates(df).withColumn("original_rows", F.col("n_rows")))


def _target_table(df: DataFrame, a: Audited) -> DataFrame:
    return target_ops.target_stats(df, [a.target]).withColumnRenamed("target", "target_column")


@query("rule_imbalance_binary", "Q5", rule_sql("IMBALANCE_BINARY", "late_lines", "labelled_documents"))
def rule_imbalance_binary(t: Tables) -> DataFrame:
    return over(t, "IMBALANCE_BINARY", ("late_lines", "labelled_documents"), table=_target_table)


@query("rule_imbalance_multiclass", "Q6 T11", rule_sql("IMBALANCE_MULTICLASS", "suppliers", "event_values"))
def rule_imbalance_multiclass(t: Tables) -> DataFrame:
    return over(t, "IMBALANCE_MULTICLASS", ("suppliers", "event_values"), table=_target_table)


def _sizes(df: DataFrame, a: Audited) -> DataFrame:
    size = structure.structure(df).drop("memory_mb").withColumn("target_column", F.lit(a.target).cast("string"))
    return size.withColumn("original_rows", F.col("n_rows"))


@query("rule_small_dataset", "Q7", rule_sql("SMALL_DATASET", "regions", "suppliers", "texts"))
def rule_small_dataset(t: Tables) -> DataFrame:
    return over(t, "SMALL_DATASET", ("regions", "suppliers", "texts"), table=_sizes)


@query("rule_too_few_features", "Q8", rule_sql("TOO_FEW_FEATURES", "regions", "suppliers", "texts"))
def rule_too_few_features(t: Tables) -> DataFrame:
    return over(t, "TOO_FEW_FEATURES", ("regions", "suppliers", "texts"), table=_sizes)


def _variation(df: DataFrame, a: Audited) -> DataFrame:
    groups = column_groups(df, a.target)
    numbers = numeric.moments(df, groups["numeric"]).select("column", "mean", "std")
    texts = categorical.entropies(categorical.distinct_counts(df, groups["categorical"])).select("column", "normalized_entropy")
    return numbers.unionByName(texts, allowMissingColumns=True)


@query("rule_low_variance", "Q9", rule_sql("LOW_VARIANCE", "priced_lines", "event_values"))
def rule_low_variance(t: Tables) -> DataFrame:
    return over(t, "LOW_VARIANCE", ("priced_lines", "event_values"), _variation)


def _cardinality(df: DataFrame, a: Audited) -> DataFrame:
    counts = categorical.distinct_counts(df, column_groups(df, a.target)["categorical"])
    return categorical.with_cardinality(categorical.entropies(counts), df.count()).select("column", "cardinality_ratio")


@query("rule_high_cardinality", "Q10", rule_sql("HIGH_CARDINALITY", "labelled_documents", "suppliers", "event_values"))
def rule_high_cardinality(t: Tables) -> DataFrame:
    return over(t, "HIGH_CARDINALITY", ("labelled_documents", "suppliers", "event_values"), _cardinality)


@query("rule_outliers", "Q11", rule_sql("OUTLIERS", "event_values", "late_lines"))
def rule_outliers(t: Tables) -> DataFrame:
    def found(df: DataFrame, a: Audited) -> DataFrame:
        return numeric.outliers(df, column_groups(df, a.target)["numeric"]).select("column", "outliers_pct")

    return over(t, "OUTLIERS", ("event_values", "late_lines"), found)


@query("rule_date_not_parsed", "Q12 X1", rule_sql("DATE_NOT_PARSED", "priced_lines", "labelled_documents"))
def rule_date_not_parsed(t: Tables) -> DataFrame:
    def found(df: DataFrame, a: Audited) -> DataFrame:
        texts = [n for n, k in df.dtypes if k == "string"]
        return profile_plan.text_date_shares(df, texts)

    return over(t, "DATE_NOT_PARSED", ("priced_lines", "labelled_documents"), found)


@query(
    "date_share",
    "X1",
    f"""SELECT o_orderpriority, {r("count(try_strptime(d, '%Y-%m-%d')) / count(d)")} AS share FROM (
    SELECT o_orderpriority, CASE WHEN o_orderstatus = 'P' THEN 'soon' WHEN o_orderstatus = 'F' THEN strftime(o_orderdate, '%Y-%m-%d') END AS d FROM orders) GROUP BY 1""",
)
def date_share_query(t: Tables) -> DataFrame:
    text = F.when(F.col("o_orderstatus") == "P", "soon").when(F.col("o_orderstatus") == "F", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.groupBy("o_orderpriority").agg(date_share(text).alias("share"))


_SPELLINGS = (
    "yyyy-MM-dd", "d MMMM yyyy", "MMM d, yyyy", "yyyy-MM-dd'T12:00:00.123456+02:00'", "MM/dd/yyyy '01:30 PM'", "dd.MM.yyyy", "'week'", "'31.02.'yyyy",
    "EEE, dd MMM yyyy '10:00:00 GMT'", "yyyyMMdd",
)


@query(
    "date_spellings",
    "X1 Q12",
    f"""SELECT o_orderkey % {len(_SPELLINGS)} AS spelling, count(*) AS n, count(CASE WHEN o_orderkey % {len(_SPELLINGS)} NOT IN (6, 7) THEN 1 END) AS n_dates,
    min(CASE WHEN o_orderkey % {len(_SPELLINGS)} NOT IN (6, 7) THEN CAST(o_orderdate AS DATE) END) AS first, max(CASE WHEN o_orderkey % {len(_SPELLINGS)} NOT IN (6, 7) THEN CAST(o_orderdate AS DATE) END) AS last
    FROM orders GROUP BY 1""",
)
def date_spellings(t: Tables) -> DataFrame:
    """The days of orders written in ten ways, two of them no dates, and read back."""
    way = F.col("o_orderkey") % len(_SPELLINGS)
    text = F.coalesce(*[F.when(way == k, F.date_format("o_orderdate", spelling)) for k, spelling in enumerate(_SPELLINGS)])
    rows = t.orders.select(way.alias("spelling"), text.alias("d"))
    dotted = F.col("spelling") == 5  # written with the day first
    day = F.when(dotted, parsed_date(F.col("d"), day_first=True)).otherwise(parsed_date(F.col("d"))).cast("date")
    return rows.groupBy("spelling").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(is_date(F.col("d")), 1)).alias("n_dates"), F.min(day).alias("first"), F.max(day).alias("last"))


_CARDINALITY_ROWS = union_all(
    [f"SELECT 'HIGH_CARDINALITY' AS rule_code, '{c}' AS \"column\", count(DISTINCT {c}) / count(*) AS v, 'distinct values per row' AS what, 0.5 AS bound FROM d" for c in ("text", "lang", "source")]
)


@query(
    "flag_messages",
    "X2",
    f"""WITH d AS (SELECT text, lang, source, toxic FROM documents LEFT JOIN labels USING (doc_id)), m AS ({_CARDINALITY_ROWS}
    UNION ALL SELECT 'TARGET_MISSING', 'toxic', 1 - count(toxic) / count(*), 'share of missing target values', 0.05 FROM d
    UNION ALL SELECT 'DUPLICATES', NULL, 1 - count(DISTINCT text) / count(*), 'share of repeated rows', 0.05 FROM d)
    SELECT 'labelled_documents' AS dataset, rule_code, "column",
      format('{{}}: {{}} = {{:.3f}} ({{}} fires more than {{:.3f}})', coalesce("column", 'table'), what, v::DOUBLE, rule_code, bound::DOUBLE) AS message
    FROM m WHERE v > bound""",
)
def flag_messages(t: Tables) -> DataFrame:
    """The sentences shown to the user."""
    a = BY_NAME["labelled_documents"]
    df = a.build(t)
    columns = structure.missing_by_column(df).drop("n_rows").join(_cardinality(df, a), "column", "left")
    name = F.lit(a.name)
    full = _with_fields(columns.withColumn("dataset", name).withColumn("is_target", F.col("column") == a.target), COLUMN_FIELDS)
    table = _with_fields(structure.duplicates(df.select("text")).withColumn("dataset", name).withColumn("original_rows", F.col("n_rows")).withColumn("n_cols", F.lit(6)), TABLE_FIELDS)
    return quality_flags(table, full, default_rules(t.spark)).select("dataset", "rule_code", "column", "message")


# ---- recommendation -------------------------------------------------------------------

_SIZES = {"orders": 6, "lineitem": 11, "part": 6, "customer": 5, "embeddings": 3, "labels": 3, "events": 6, "supplier": 4}


def candidate_profiles(t: Tables) -> DataFrame:
    """Target facts of every candidate target, and two tables without a target."""
    sizes = None
    for name in [*_SIZES, "region"]:
        one = structure.structure(getattr(t, name)).select(F.lit(name).alias("table"), "n_rows", "n_cols")
        sizes = one if sizes is None else sizes.unionByName(one)
    facts = sizes.join(target_facts(t), "table").withColumnRenamed("target", "target_column")
    none = sizes.where(F.col("table").isin("lineitem", "region"))
    rows = facts.unionByName(none, allowMissingColumns=True)
    return rows.withColumn("dataset", F.concat_ws(".", "table", "target_column"))


_FACTS = union_all([target_sql(*x) for x in _TARGETS])
_DECIDED = f"""SELECT concat_ws('.', t, c) AS dataset, n_rows, CASE
  WHEN c IS NULL AND n_cols > 10 THEN 'CLUSTERING|0.8|false|NO_TARGET_HIGH_DIM,DIMENSIONALITY_REDUCTION'
  WHEN c IS NULL THEN 'CLUSTERING|0.9|false|NO_TARGET_LOW_DIM'
  WHEN num AND u <= 2 THEN 'BINARY_CLASSIFICATION|0.95|false|NUMERIC_BINARY_TARGET'
  WHEN num AND u <= 10 THEN 'MULTICLASS_CLASSIFICATION|0.5|true|AMBIGUOUS_NUMERIC_TARGET'
  WHEN num AND u <= 20 AND coalesce(abs(target_skewness) < 1, false) THEN 'MULTICLASS_CLASSIFICATION|0.7|false|NUMERIC_TARGET_SYMMETRIC_FEW_VALUES'
  WHEN num AND u <= 20 THEN 'REGRESSION|0.5|true|AMBIGUOUS_NUMERIC_TARGET'
  WHEN num THEN 'REGRESSION|0.95|false|NUMERIC_TARGET_MANY_VALUES'
  WHEN u < 2 THEN 'NOT_READY|0.99|false|ONLY_ONE_CLASS'
  WHEN u = 2 AND target_imbalance_ratio > 10 THEN 'BINARY_CLASSIFICATION|0.9|false|BINARY_IMBALANCED'
  WHEN u = 2 THEN 'BINARY_CLASSIFICATION|0.95|false|BINARY_BALANCED'
  WHEN u <= 20 AND min_class_size < 50 THEN 'MULTICLASS_CLASSIFICATION|0.85|false|MULTICLASS'
  WHEN u <= 20 THEN 'MULTICLASS_CLASSIFICATION|0.95|false|MULTICLASS'
  WHEN u / n_rows > 0.5 THEN 'NOT_READY|0.8|false|TARGET_LOOKS_LIKE_ID'
  ELSE 'MULTICLASS_CLASSIFICATION|0.6|true|HIGH_CARDINALITY_MULTICLASS' END AS decision
  FROM (SELECT f."table" AS t, target AS c, n_rows, n_cols, target_n_unique AS u, target_skewness, target_imbalance_ratio, min_class_size,
      target_kind = 'regression' OR (target_n_unique BETWEEN 3 AND 20 AND all_number_labels) AS num FROM ({_FACTS}) f
    JOIN ({union_all([f"SELECT '{n}' AS t, count(*) AS n_rows, {c} AS n_cols FROM {n}" for n, c in _SIZES.items()])}) s ON s.t = f."table"
    UNION ALL SELECT 'lineitem', NULL, count(*), 11, NULL, NULL, NULL, NULL, NULL FROM lineitem
    UNION ALL SELECT 'region', NULL, count(*), 2, NULL, NULL, NULL, NULL, NULL FROM region)"""
_SHOWN_DECISION = """SELECT dataset, split_part(decision, '|', 1) AS task_type_code, split_part(decision, '|', 2)::DOUBLE AS confidence,
  split_part(decision, '|', 3) = 'true' AS requires_ml, split_part(decision, '|', 4) AS rule_codes"""


@query("task_recommendations", "R1 R2 R3 R5 R7 R8 R9 R10 R11 R12 R13 R14 R15", f"{_SHOWN_DECISION} FROM ({_DECIDED})")
def task_recommendations(t: Tables) -> DataFrame:
    """The decision table over every candidate target of the given tables at once."""
    decided = decide(candidate_profiles(t))
    return decided.select("dataset", "task_type_code", "confidence", "requires_ml", F.array_join("rule_codes", ",").alias("rule_codes"))


@query(
    "warned_recommendations",
    "R17 U2",
    f"""SELECT dataset, task_type_code, confidence, rule_codes || CASE WHEN n_rows < 100 THEN ',SMALL_DATASET' ELSE '' END AS rule_codes
    FROM ({_SHOWN_DECISION}, n_rows FROM ({_DECIDED}))""",
)
def warned_recommendations(t: Tables) -> DataFrame:
    """Critical flags are appended as warnings; task and confidence stay."""
    rows = candidate_profiles(t).withColumn("original_rows", F.col("n_rows")).withColumn("duplicate_rows_pct", F.lit(0.0)).withColumn("min_class", F.lit(""))
    none = _with_fields(t.spark.createDataFrame([], "dataset string, column string"), COLUMN_FIELDS)
    decided = with_warnings(decide(rows), quality_flags(rows, none, default_rules(t.spark)))
    return decided.select("dataset", "task_type_code", "confidence", F.array_join("rule_codes", ",").alias("rule_codes"))


_TEXT_ROWS = ", ".join(f"('{code}', '{text}')" for code, text in {**RULE_TEXTS, **WARNING_TEXTS}.items())
_TASK_ROWS = ", ".join(f"('{code}', '{name}')" for code, name in TASK_NAMES.items())


@query(
    "recommendation_texts",
    "X3 R18",
    f"""WITH d AS ({_SHOWN_DECISION} FROM ({_DECIDED})), texts AS (SELECT * FROM (VALUES {_TEXT_ROWS}) v(code, text)),
    names AS (SELECT * FROM (VALUES {_TASK_ROWS}) v(task_type_code, name)),
    c AS (SELECT dataset, unnest(string_split(rule_codes, ',')) AS code, generate_subscripts(string_split(rule_codes, ','), 1) AS place FROM d),
    b AS (SELECT dataset, string_agg('- ' || text, chr(10) ORDER BY place) AS bullets,
      '[' || string_agg('{{"code":"' || code || '","description":"' || text || '"}}', ',' ORDER BY place) || ']' AS applied_rules FROM c JOIN texts USING (code) GROUP BY dataset)
    SELECT dataset, task_type_code, confidence, 'rules' AS source, applied_rules,
      'task: ' || name || chr(10) || 'grounds:' || chr(10) || bullets || chr(10) || 'model: no trained model, rules alone' AS explanation
    FROM d JOIN b USING (dataset) JOIN names USING (task_type_code)""",
)
def recommendation_texts(t: Tables) -> DataFrame:
    """Without a model the rules stand; the explanation says so."""
    return hybrid(decide(candidate_profiles(t))).select(
        "dataset", "task_type_code", "confidence", "source", F.to_json(applied_rules()).alias("applied_rules"), "explanation"
    )


@query("clustering_tables", "R1 R2", "SELECT * FROM (VALUES ('lineitem', 0.8::DOUBLE), ('region', 0.9)) v(dataset, confidence)")
def clustering_tables(t: Tables) -> DataFrame:
    decided = decide(candidate_profiles(t))
    return decided.where(F.col("task_type_code") == CLUSTERING).select("dataset", "confidence")
