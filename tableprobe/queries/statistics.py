"""Queries for the column statistics, histograms, samples and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import finite
from tableprobe.operators import categorical, distribution, normality, numeric, order_stats, preparation, sampling, structure
from tableprobe.operators import target as target_ops
from tableprobe.queries.registry import Tables, query, r, union_all
from tableprobe.session import cut_lineage

LINE_NUMBERS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]
ORDER_TEXTS = ["o_orderstatus", "o_orderpriority"]
CUSTOMER_TEXTS = ["c_name", "c_mktsegment"]

DOC_LABELS = "documents LEFT JOIN labels USING (doc_id)"
GAPPY = "(SELECT *, nullif(l_tax, 0) AS tax_or_null, CASE WHEN l_returnflag = 'R' THEN l_discount END AS discount_r FROM lineitem)"


def documents_with_labels(t: Tables) -> DataFrame:
    return t.documents.join(t.labels, "doc_id", "left")


def gappy(t: Tables) -> DataFrame:
    """lineitem with two columns that have missing values."""
    return t.lineitem.withColumns(
        {
            "tax_or_null": F.nullif(F.col("l_tax"), F.lit(0.0)),
            "discount_r": F.when(F.col("l_returnflag") == "R", F.col("l_discount")),
        }
    )


# ---- structure ------------------------------------------------------------------------


@query(
    "table_structure",
    "A1",
    union_all([f"SELECT '{t}' AS \"table\", count(*) AS n_rows, {n}::BIGINT AS n_cols FROM {t}"
               for t, n in (("lineitem", 11), ("orders", 6), ("documents", 5), ("embeddings", 3), ("pages", 3))]),
)
def table_structure(t: Tables) -> DataFrame:
    out = None
    for name in ("lineitem", "orders", "documents", "embeddings", "pages"):
        one = structure.structure(getattr(t, name)).select(F.lit(name).alias("table"), "n_rows", "n_cols")
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "table_bytes",
    "A1",
    f"""SELECT 'documents' AS "table", {r("(sum(strlen(text) + strlen(lang) + strlen(source) + 16)) / 1048576.0")} AS memory_mb FROM documents
    UNION ALL SELECT 'orders', {r("(sum(strlen(o_orderstatus) + strlen(o_orderpriority) + 32)) / 1048576.0")} FROM orders""",
)
def table_bytes(t: Tables) -> DataFrame:
    parts = [structure.structure(getattr(t, n)).select(F.lit(n).alias("table"), "memory_mb") for n in ("documents", "orders")]
    return parts[0].unionByName(parts[1])


@query(
    "column_type_counts",
    "A1",
    """SELECT * FROM (VALUES ('bigint', 3::BIGINT), ('double', 4), ('int', 1), ('string', 2), ('timestamp', 1)) v("type", n_columns)""",
)
def column_type_counts(t: Tables) -> DataFrame:
    counts = structure.type_counts(t.lineitem)
    rows = [("timestamp" if k.startswith("timestamp") else k, v) for k, v in counts.items()]
    return t.spark.createDataFrame(rows, "type string, n_columns long")


_DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]


@query(
    "missing_by_column",
    "A2",
    union_all(
        [f"SELECT '{c}' AS \"column\", count(*) AS n_rows, count(*) - count({c}) AS n_missing, "
         f"{r(f'(count(*) - count({c})) / count(*)')} AS missing_pct FROM {DOC_LABELS}" for c in _DOC_COLUMNS]
    ),
)
def missing_by_column(t: Tables) -> DataFrame:
    return structure.missing_by_column(documents_with_labels(t))


@query(
    "missing_totals",
    "A2",
    f"""SELECT {r("sum(m) / (7.0 * max(n))")} AS total_missing_pct, {r("max(m / n)")} AS max_col_missing_pct FROM (
    {union_all([f"SELECT count(*) AS n, count(*) - count({c}) AS m FROM {DOC_LABELS}" for c in _DOC_COLUMNS])})""",
)
def missing_totals(t: Tables) -> DataFrame:
    return structure.missing_totals(structure.missing_by_column(documents_with_labels(t)))


@query(
    "duplicate_rows",
    "A3",
    f"""SELECT sum(c)::BIGINT AS n_rows, sum(c - 1)::BIGINT AS n_duplicates, {r("sum(c - 1) / sum(c)")} AS duplicate_rows_pct
    FROM (SELECT count(*) AS c FROM documents GROUP BY text, lang, source, n_chars)""",
)
def duplicate_rows(t: Tables) -> DataFrame:
    return structure.duplicates(t.documents.drop("doc_id"))


@query(
    "duplicate_rows_with_nulls",
    "A3",
    f"""SELECT sum(c)::BIGINT AS n_rows, sum(c - 1)::BIGINT AS n_duplicates, {r("sum(c - 1) / sum(c)")} AS duplicate_rows_pct
    FROM (SELECT count(*) AS c FROM {GAPPY} GROUP BY l_linenumber, l_quantity, tax_or_null, discount_r)""",
)
def duplicate_rows_with_nulls(t: Tables) -> DataFrame:
    return structure.duplicates(gappy(t).select("l_linenumber", "l_quantity", "tax_or_null", "discount_r"))


# ---- numbers --------------------------------------------------------------------------


def moments_sql(c: str, source: str) -> str:
    d = f"({c}::DOUBLE - (SELECT avg({c}::DOUBLE) FROM {source}))"
    m2, m3, m4 = (f"avg(pow({d}, {k}))" for k in (2, 3, 4))
    return (
        f"SELECT '{c}' AS \"column\", count({c}) AS n_finite, {r(f'avg({c}::DOUBLE)')} AS mean, {r(f'stddev_pop({c}::DOUBLE)')} AS std, "
        f"{r(f'{m3} / pow({m2}, 1.5)')} AS skewness, {r(f'{m4} / pow({m2}, 2) - 3')} AS kurtosis, "
        f"{r(f'min({c})')} AS min, {r(f'max({c})')} AS max FROM {source}"
    )


@query("numeric_moments", "A4 A5 A6 F3", union_all([moments_sql(c, GAPPY) for c in [*LINE_NUMBERS, "tax_or_null", "discount_r"]]))
def numeric_moments(t: Tables) -> DataFrame:
    return numeric.moments(gappy(t), [*LINE_NUMBERS, "tax_or_null", "discount_r"])


@query("event_value_moments", "A4 A5 A6", moments_sql("value", "events"))
def event_value_moments(t: Tables) -> DataFrame:
    return numeric.moments(t.events, ["value"])


@query(
    "quartiles",
    "A7",
    union_all(
        [f"SELECT '{c}' AS \"column\", {s}::DOUBLE AS share, {r(f'quantile_cont({c}::DOUBLE, {s})')} AS value FROM {GAPPY}"
         for c in [*LINE_NUMBERS, "tax_or_null"] for s in (0.25, 0.5, 0.75)]
    ),
)
def quartiles(t: Tables) -> DataFrame:
    return order_stats.quantile_table(gappy(t), [*LINE_NUMBERS, "tax_or_null"], [0.25, 0.5, 0.75])


def iqr_sql(c: str, source: str) -> str:
    q = f"(SELECT quantile_cont({c}::DOUBLE, 0.25) AS q1, quantile_cont({c}::DOUBLE, 0.75) AS q3 FROM {source})"
    out = f"{c} < q1 - 1.5 * (q3 - q1) OR {c} > q3 + 1.5 * (q3 - q1)"
    return f"SELECT '{c}' AS \"column\", count({c}) AS n_finite, count(*) FILTER ({out}) AS n_outliers, {r(f'count(*) FILTER ({out}) / count({c})')} AS outliers_pct FROM {source}, {q}"


_SKEWED = "(SELECT value, value * value AS value_squared, user_id FROM events)"


def skewed(t: Tables) -> DataFrame:
    return t.events.select("value", (F.col("value") * F.col("value")).alias("value_squared"), "user_id")


@query("iqr_outliers", "A8", union_all([iqr_sql(c, _SKEWED) for c in ("value", "value_squared", "user_id")]))
def iqr_outliers(t: Tables) -> DataFrame:
    found = numeric.outliers(skewed(t), ["value", "value_squared", "user_id"])
    return found.select("column", "n_finite", "n_outliers", "outliers_pct")


def z_sql(c: str, source: str) -> str:
    m = f"(SELECT avg({c}::DOUBLE) AS m, stddev_pop({c}::DOUBLE) AS s FROM {source})"
    out = f"abs(({c} - m) / nullif(s, 0)) > 3"
    return f"SELECT '{c}' AS \"column\", count({c}) AS n_finite, count(*) FILTER ({out}) AS n_outliers, {r(f'count(*) FILTER ({out}) / count({c})')} AS outliers_pct FROM {source}, {m}"


@query("z_outliers", "A9", union_all([z_sql(c, _SKEWED) for c in ("value", "value_squared", "user_id")]))
def z_outliers(t: Tables) -> DataFrame:
    columns = ["value", "value_squared", "user_id"]
    found = numeric.outliers(skewed(t), columns, normal=set(columns))
    return found.select("column", "n_finite", "n_outliers", "outliers_pct")


@query("outliers_by_shape", "A10", union_all([z_sql("value", _SKEWED), iqr_sql("value_squared", _SKEWED)]))
def outliers_by_shape(t: Tables) -> DataFrame:
    """z-score for a column judged normal, fences for the other."""
    found = numeric.outliers(skewed(t), ["value", "value_squared"], normal={"value"})
    return found.select("column", "n_finite", "n_outliers", "outliers_pct")


def normality_sql(c: str, source: str) -> str:
    d = f"({c}::DOUBLE - (SELECT avg({c}::DOUBLE) FROM {source}))"
    m2, m3, m4 = (f"avg(pow({d}, {k}))" for k in (2, 3, 4))
    jb = f"(count({c}) / 6 * (pow({m3} / pow({m2}, 1.5), 2) + pow({m4} / pow({m2}, 2) - 3, 2) / 4))"
    return f"SELECT '{c}' AS \"column\", {r(jb)} AS jb, {r(f'exp(-{jb} / 2)')} AS p_value, exp(-{jb} / 2) > 0.05 AS is_normal FROM {source}"


@query("normality_test", "A11", union_all([normality_sql("value", "events"), normality_sql("user_id", "events"), normality_sql("c_acctbal", "customer")]))
def normality_test(t: Tables) -> DataFrame:
    return normality.normality(t.events, ["value", "user_id"]).unionByName(normality.normality(t.customer, ["c_acctbal"]))


_ROLLED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "flat"]
_ROLL_SOURCE = "(SELECT *, 7.0 AS flat FROM lineitem)"


@query(
    "numeric_rollup",
    "A12",
    f"""WITH c AS ({union_all([moments_sql(c, _ROLL_SOURCE).replace("'" + c + "' AS", "'" + c + "' AS") for c in _ROLLED if c != 'flat'])}),
    o AS ({union_all([iqr_sql(c, _ROLL_SOURCE) for c in _ROLLED])})
    SELECT (SELECT {r('avg(skewness)')} FROM c) AS mean_skewness, (SELECT {r('avg(kurtosis)')} FROM c) AS mean_kurtosis,
    (SELECT {r('sum(n_outliers) / sum(n_finite)')} FROM o) AS outliers_pct, 1::BIGINT AS n_low_variance""",
)
def numeric_rollup(t: Tables) -> DataFrame:
    data = t.lineitem.withColumn("flat", F.lit(7.0))
    rows = numeric.moments(data, _ROLLED)
    found = numeric.outliers(data, _ROLLED)
    both = rows.join(found.select("column", "n_outliers"), "column").withColumn("p_value", F.lit(None).cast("double"))
    rolled = numeric.numeric_summary(both.select(*[F.round(c, 6).alias(c) if c in ("skewness", "kurtosis") else F.col(c) for c in both.columns]))
    return rolled.drop("normality_test_pvalue")


@query(
    "low_variance_columns",
    "A12",
    f"""SELECT * FROM ({union_all([
        f'''SELECT '{c}' AS "column", {r(f"stddev_pop({c}::DOUBLE)")} AS std, (stddev_pop({c}::DOUBLE) = 0 OR (avg({c}) <> 0 AND stddev_pop({c}::DOUBLE) / abs(nullif(avg({c}), 0)) < 0.01)) AS low_variance FROM (SELECT *, 7.0::DOUBLE AS flat, 1000 + l_tax AS shifted FROM lineitem)'''
        for c in ("l_quantity", "flat", "shifted")])})""",
)
def low_variance_columns(t: Tables) -> DataFrame:
    data = t.lineitem.withColumn("flat", F.lit(7.0)).withColumn("shifted", 1000 + F.col("l_tax"))
    rows = numeric.moments(data, ["l_quantity", "flat", "shifted"])
    return rows.select("column", "std", F.coalesce(numeric.low_variance(F.col("mean"), F.col("std")), F.lit(False)).alias("low_variance"))


# ---- categories -----------------------------------------------------------------------


def entropy_sql(c: str, table: str) -> str:
    counts = f"(SELECT {c} AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY {c})"
    total = f"(SELECT count({c}) FROM {table})"
    h = f"greatest(0.0, -sum(n / {total} * log2(n / {total})))"
    return (
        f"SELECT '{c}' AS \"column\", sum(n)::BIGINT AS n_values, count(*) AS n_distinct, {r(h)} AS entropy, "
        f"{r(f'CASE WHEN count(*) <= 1 THEN 0.0 ELSE {h} / log2(count(*)) END')} AS normalized_entropy FROM {counts}"
    )


@query("category_entropy", "A13 A14", union_all([entropy_sql(c, "orders") for c in ORDER_TEXTS]))
def category_entropy(t: Tables) -> DataFrame:
    return categorical.entropies(categorical.distinct_counts(t.orders, ORDER_TEXTS))


@query("entropy_of_ids_and_texts", "A13 A14", union_all([entropy_sql("text", "documents"), entropy_sql("lang", "documents"), entropy_sql("source", "documents")]))
def entropy_of_ids_and_texts(t: Tables) -> DataFrame:
    return categorical.entropies(categorical.distinct_counts(t.documents, ["text", "lang", "source"]))


@query(
    "top_texts",
    "A21 A22",
    union_all(
        [f"""SELECT '{c}' AS "column", n, (total - shown)::BIGINT AS other_count, len::INTEGER AS length FROM (
          SELECT *, sum(n) OVER () AS total, sum(CASE WHEN rn <= 20 THEN n ELSE 0 END) OVER () AS shown FROM (
            SELECT length({c}) AS len, n, row_number() OVER (ORDER BY n DESC, md5({c})) AS rn
            FROM (SELECT {c}, count(*) AS n FROM documents GROUP BY 1))) WHERE rn <= 20""" for c in ("text", "lang", "source")]
    ),
)
def top_texts(t: Tables) -> DataFrame:
    """Top values of columns that hold whole documents, counted by key."""
    columns = ["text", "lang", "source"]
    top = cut_lineage(categorical.top_with_rest(categorical.distinct_counts(t.documents, columns)))
    return categorical.with_long_texts(top, t.documents, columns).select("column", "n", "other_count", F.length("value").alias("length"))


@query(
    "cardinality",
    "A15",
    union_all(
        [f"SELECT '{c}' AS \"column\", count(DISTINCT {c}) AS n_distinct, {r(f'count(DISTINCT {c}) / count(*)')} AS cardinality_ratio, "
         f"count(DISTINCT {c}) / count(*) > 0.5 AS high FROM {table}"
         for c, table in (("c_name", "customer"), ("c_mktsegment", "customer"), ("quality", f"(SELECT quality::VARCHAR AS quality FROM {DOC_LABELS})"))]
    ),
)
def cardinality(t: Tables) -> DataFrame:
    out = None
    for df, columns in ((t.customer, CUSTOMER_TEXTS), (documents_with_labels(t), ["quality"])):
        n_rows = df.count()
        per = categorical.with_cardinality(categorical.entropies(categorical.distinct_counts(df, columns)), n_rows)
        part = per.select("column", "n_distinct", "cardinality_ratio", (F.col("cardinality_ratio") > 0.5).alias("high"))
        out = part if out is None else out.unionByName(part)
    return out


_TARGETS = [
    ("orders", "o_orderstatus", False), ("orders", "o_totalprice", True), ("lineitem", "l_returnflag", False),
    ("lineitem", "l_quantity", True), ("part", "p_size", True), ("customer", "c_name", False),
    ("embeddings", "label", True), ("labels", "toxic", True), ("events", "event_type", False), ("supplier", "s_nationkey", True),
]


def target_sql(table: str, c: str, number: bool) -> str:
    counts = f"(SELECT {c} AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY {c})"
    limit = "greatest(20, floor(0.05 * sum(n)))"
    kind = f"CASE WHEN {str(number).lower()} AND count(*) > {limit} THEN 'regression' ELSE 'categorical' END"
    h = "log2(sum(n)) - sum(n * log2(n)) / sum(n)"
    if number:
        d = f"({c}::DOUBLE - (SELECT avg({c}::DOUBLE) FROM {table}))"
        skew = f"(SELECT avg(pow({d}, 3)) / pow(avg(pow({d}, 2)), 1.5) FROM {table})"
        labels = "true"
    else:
        skew = "NULL"
        labels = "bool_and(coalesce(isfinite(try_cast(trim(v) AS DOUBLE)), false))"
    return f"""SELECT '{table}' AS "table", '{c}' AS target, {kind} AS target_kind, count(*) AS target_n_unique,
      CASE WHEN {kind} = 'categorical' AND count(*) >= 2 THEN {r('max(n) / min(n)')} END AS target_imbalance_ratio,
      CASE WHEN {kind} = 'categorical' THEN {r(f'greatest(0.0, {h})')} END AS target_class_entropy,
      CASE WHEN {kind} = 'regression' THEN {r(skew)} END AS target_skewness,
      CASE WHEN {kind} = 'categorical' THEN min(n) END AS min_class_size,
      CASE WHEN {kind} = 'categorical' THEN {labels} END AS all_number_labels
      FROM {counts}"""


def target_facts(t: Tables) -> DataFrame:
    by_table: dict[str, list[str]] = {}
    for table, c, _ in _TARGETS:
        by_table.setdefault(table, []).append(c)
    out = None
    for table, columns in by_table.items():
        part = target_ops.target_stats(getattr(t, table), columns).withColumn("table", F.lit(table))
        out = part if out is None else out.unionByName(part)
    return out


@query("target_profiles", "A16 A17", union_all([target_sql(*x) for x in _TARGETS]))
def target_profiles(t: Tables) -> DataFrame:
    return target_facts(t).drop("min_class")


@query("class_counts", "A17 A30 P2", "SELECT toxic::VARCHAR AS label, count(*) AS n FROM labels GROUP BY 1")
def class_counts(t: Tables) -> DataFrame:
    return target_ops.class_counts(documents_with_labels(t), "toxic").orderBy(F.desc("n"), "label")


@query(
    "class_count_map",
    "X9 A17",
    """SELECT '{' || string_agg('"' || event_type || '":' || n, ',' ORDER BY event_type) || '}' AS value_counts FROM (SELECT event_type, count(*) AS n FROM events GROUP BY 1)""",
)
def class_count_map(t: Tables) -> DataFrame:
    return target_ops.class_map(target_ops.class_counts(t.events, "event_type")).select(F.to_json("value_counts").alias("value_counts"))


def top_sql(c: str, table: str, k: int) -> str:
    return f"""SELECT '{c}' AS "column", rn::INTEGER AS rank, v AS value, n, (total - shown)::BIGINT AS other_count FROM (
      SELECT v, n, rn, sum(n) OVER () AS total, sum(CASE WHEN rn <= {k} THEN n ELSE 0 END) OVER () AS shown FROM (
        SELECT v, n, row_number() OVER (ORDER BY n DESC, md5(v)) AS rn FROM (
          SELECT {c}::VARCHAR AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1))) WHERE rn <= {k}"""


@query("top_categories", "A21 W1 T8", union_all([top_sql("p_brand", "part", 20), top_sql("p_type", "part", 20), top_sql("p_name", "part", 20)]))
def top_categories(t: Tables) -> DataFrame:
    return categorical.top_with_rest(categorical.value_counts(t.part, ["p_brand", "p_type", "p_name"]))


@query(
    "categories_with_other",
    "T8",
    f"""WITH x AS ({top_sql("p_brand", "part", 15)}) SELECT "column", rank, value, n FROM x
    UNION ALL SELECT 'p_brand', 16, 'other (' || max(other_count) || ')', max(other_count) FROM x HAVING max(other_count) > 0""",
)
def categories_with_other(t: Tables) -> DataFrame:
    return categorical.folded_top(categorical.value_counts(t.part, ["p_brand"]), 15)


@query(
    "rarest_class",
    "T11",
    """SELECT arg_min(v, n * 1000000 + rn) AS label, min(n) AS n FROM (SELECT v, n, row_number() OVER (ORDER BY v) AS rn FROM (
    SELECT event_type AS v, count(*) AS n FROM events GROUP BY 1))""",
)
def rarest_class(t: Tables) -> DataFrame:
    facts = target_ops.target_stats(t.events, ["event_type"])
    return facts.select(F.col("min_class").alias("label"), F.col("min_class_size").alias("n"))


@query(
    "fill_values",
    "A31",
    f"""SELECT 'l_tax' AS "column", {r("median(tax_or_null)")}::VARCHAR AS fill FROM {GAPPY}
    UNION ALL SELECT 'discount_r', {r("median(discount_r)")}::VARCHAR FROM {GAPPY}
    UNION ALL SELECT 'empty', '0.0'
    UNION ALL SELECT 'l_returnflag', (SELECT l_returnflag FROM lineitem GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
    UNION ALL SELECT 'nothing', 'MISSING'""",
)
def fill_values(t: Tables) -> DataFrame:
    data = gappy(t).drop("l_tax").withColumnRenamed("tax_or_null", "l_tax")
    data = data.withColumn("empty", F.lit(None).cast("double")).withColumn("nothing", F.lit(None).cast("string"))
    fills = preparation.fill_values(data, ["l_tax", "discount_r", "empty"], ["l_returnflag", "nothing"])
    rows = [(c, str(round(v, 6)) if isinstance(v, float) else v) for c, v in fills.items()]
    return t.spark.createDataFrame(rows, "column string, fill string")


# ---- histograms -----------------------------------------------------------------------


def histogram_sql(c: str, table: str, bins: int = 30) -> str:
    return f"""SELECT '{c}' AS "column", b::INTEGER AS bin, coalesce(n, 0)::BIGINT AS n, {r('lo + b * w')} AS bin_start,
      {r('lo + b * w + w')} AS bin_end, {r('lo + b * w + w / 2')} AS bin_center, {r('w')} AS bin_width
      FROM (SELECT lo, hi, (hi - lo) / {bins} AS w FROM (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
        CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM (SELECT {c}::DOUBLE AS v FROM {table})))
      CROSS JOIN (SELECT unnest(range({bins})) AS b)
      LEFT JOIN (SELECT least(floor(({c}::DOUBLE - lo) / (hi - lo) * {bins}), {bins - 1})::INTEGER AS bin, count(*) AS n
        FROM {table}, (SELECT CASE WHEN min(v) = max(v) THEN min(v) - 0.5 ELSE min(v) END AS lo,
          CASE WHEN min(v) = max(v) THEN max(v) + 0.5 ELSE max(v) END AS hi FROM (SELECT {c}::DOUBLE AS v FROM {table}))
        WHERE {c} IS NOT NULL GROUP BY 1) ON bin = b"""


_FLAT = "(SELECT *, 7.0::DOUBLE AS flat FROM lineitem)"


@query("histograms", "M1 M2 A22", union_all([histogram_sql(c, _FLAT) for c in ("l_quantity", "l_extendedprice", "l_discount", "flat")] + [histogram_sql("tax_or_null", GAPPY)]))
def histograms(t: Tables) -> DataFrame:
    data = gappy(t).withColumn("flat", F.lit(7.0))
    return distribution.histograms(data, ["l_quantity", "l_extendedprice", "l_discount", "flat", "tax_or_null"])


@query("event_value_histogram", "M1", histogram_sql("value", "events"))
def event_value_histogram(t: Tables) -> DataFrame:
    return distribution.histograms(t.events, ["value"])


# ---- windows and samples --------------------------------------------------------------


_RANKED = [("lineitem", "l_extendedprice"), ("lineitem", "l_quantity"), ("events", "value")]


@query(
    "order_statistics",
    "W2 A7",
    union_all(
        [f"""SELECT '{c}' AS "column", rn - 1 AS rank, {r("v")} AS value FROM (SELECT {c} AS v, row_number() OVER (ORDER BY {c}) AS rn, count(*) OVER () AS n FROM {t})
        WHERE rn - 1 IN (0, n // 10, n // 3, n // 2, n - 1)""" for t, c in _RANKED]
    ),
)
def order_statistics(t: Tables) -> DataFrame:
    """Values at given ranks of the sorted column, without sorting it in one place."""
    rows = []
    for table, c in _RANKED:
        _, found = order_stats.values_at_ranks(getattr(t, table), lambda n: [0, n // 10, n // 3, n // 2, n - 1], [c])
        rows += [(c, rank, value) for rank, value in found[c].items()]
    return t.spark.createDataFrame(rows, "column string, rank long, value double")


@query(
    "random_row_sample",
    "T4",
    "SELECT o_orderkey, o_custkey, o_totalprice FROM orders ORDER BY md5(o_orderkey::VARCHAR), o_orderkey LIMIT 5000",
)
def random_row_sample(t: Tables) -> DataFrame:
    return sampling.random_sample(t.orders, "o_orderkey", 5000).select("o_orderkey", "o_custkey", "o_totalprice")


@query(
    "stratified_row_sample",
    "T5 W3",
    """SELECT o_orderkey, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey::VARCHAR)) AS rn,
    count(*) OVER (PARTITION BY o_orderstatus) AS size FROM orders) WHERE rn <= round_even(size * (5000 / (SELECT count(*) FROM orders)), 0)""",
)
def stratified_row_sample(t: Tables) -> DataFrame:
    return sampling.stratified_sample(t.orders, "o_orderstatus", "o_orderkey", 5000).select("o_orderkey", "o_orderstatus")


@query(
    "training_sample",
    "T6 F4",
    f"""SELECT doc_id, quality FROM (SELECT *, row_number() OVER (PARTITION BY quality ORDER BY md5(doc_id::VARCHAR)) AS rn,
    count(*) OVER (PARTITION BY quality) AS size FROM {DOC_LABELS} WHERE quality IS NOT NULL)
    WHERE rn <= round_even(size * (200 / (SELECT count(*) FROM labels)), 0)""",
)
def training_sample(t: Tables) -> DataFrame:
    known = target_ops.with_target(documents_with_labels(t), "quality")
    return sampling.stratified_sample(known, "quality", "doc_id", 200).select("doc_id", "quality")


@query(
    "sampling_record",
    "T7",
    """SELECT 'lineitem' AS "table", count(*) > 50000 AS sampled, least(count(*), 50000)::BIGINT AS sample_size, count(*) AS original_size FROM lineitem
    UNION ALL SELECT 'orders', false, count(*), count(*) FROM orders""",
)
def sampling_record(t: Tables) -> DataFrame:
    lines = t.lineitem.withColumn("key", F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_shipdate"))
    _, one = sampling.sampled(lines, "key")
    _, two = sampling.sampled(t.orders, "o_orderkey", threshold=10**9)
    return one.withColumn("table", F.lit("lineitem")).unionByName(two.withColumn("table", F.lit("orders")))


@query(
    "stratified_folds",
    "W4",
    """SELECT o_orderkey, o_orderstatus, ((row_number() OVER (PARTITION BY o_orderstatus ORDER BY md5(o_orderkey::VARCHAR)) - 1) % 5)::INTEGER AS fold FROM orders""",
)
def stratified_folds(t: Tables) -> DataFrame:
    return sampling.stratified_folds(t.orders, "o_orderstatus", "o_orderkey").select("o_orderkey", "o_orderstatus", "fold")


@query(
    "plain_folds",
    "L6",
    """SELECT fold, count(*) AS n FROM (SELECT (('0x' || substr(md5(o_orderkey::VARCHAR), 1, 8))::BIGINT % 5)::INTEGER AS fold FROM orders) GROUP BY 1""",
)
def plain_folds(t: Tables) -> DataFrame:
    return sampling.plain_folds(t.orders, "o_orderkey").groupBy("fold").agg(F.count(F.lit(1)).alias("n"))


@query(
    "finite_values",
    "F3",
    f"""SELECT l_returnflag, count(*) AS n_rows, count(*) FILTER (l_tax <> 0 AND l_tax < 0.07) AS n_finite,
    {r("sum(CASE WHEN l_tax <> 0 AND l_tax < 0.07 THEN l_tax END)")} AS total FROM lineitem GROUP BY 1""",
)
def finite_values(t: Tables) -> DataFrame:
    """NaN, infinities and NULL all drop out of a column made to hold them."""
    spoiled = (
        F.when(F.col("l_tax") == 0, F.lit(float("nan")))
        .when(F.col("l_tax") >= 0.07, F.lit(float("-inf")))
        .otherwise(F.col("l_tax"))
    )
    clean = t.lineitem.select("l_returnflag", finite(spoiled).alias("x"))
    return clean.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n_rows"), F.count("x").alias("n_finite"), F.sum("x").alias("total"))
