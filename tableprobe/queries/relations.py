"""Queries for correlations, mutual information, vectors and encodings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.scalars import is_id_like, similarity
from tableprobe.functions.vectors import FEATURE_ORDER, distance, order_fingerprint, pad
from tableprobe.operators import preparation, relation
from tableprobe.operators.categorical import distinct_counts, entropies, value_counts, with_cardinality
from tableprobe.operators.evaluation import class_distribution
from tableprobe.operators.neighbours import nearest
from tableprobe.operators.service import page
from tableprobe.plans.catalog import similar_datasets
from tableprobe.queries.registry import Tables, query, r, union_all
from tableprobe.queries.statistics import GAPPY, LINE_NUMBERS, gappy

_CORRELATED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "tax_or_null", "discount_r", "price_twice", "flat"]
_CORR_SOURCE = f"(SELECT *, l_extendedprice * 2 + l_tax AS price_twice, 7.0::DOUBLE AS flat FROM {GAPPY})"


def correlated(t: Tables) -> DataFrame:
    return gappy(t).withColumn("price_twice", F.col("l_extendedprice") * 2 + F.col("l_tax")).withColumn("flat", F.lit(7.0))


def r_of(a: str, b: str) -> str:
    """Pairwise-complete r; NULL for a constant."""
    va, vb = f"CASE WHEN {b} IS NOT NULL THEN {a} END", f"CASE WHEN {a} IS NOT NULL THEN {b} END"
    return f"CASE WHEN min({va}) < max({va}) AND min({vb}) < max({vb}) THEN covar_pop({a}, {b}) / (stddev_pop({va}) * stddev_pop({vb})) END"


def pairs_sql(columns: list[str], source: str) -> str:
    return union_all(
        [f"SELECT '{a}' AS column_a, '{b}' AS column_b, {r_of(a, b)} AS r FROM {source}"
         for i, a in enumerate(columns) for b in columns[i + 1:]]
    )


@query("correlations", "A18", f"SELECT column_a, column_b, {r('r')} AS r FROM ({pairs_sql(_CORRELATED, _CORR_SOURCE)})")
def correlations(t: Tables) -> DataFrame:
    return relation.correlations(correlated(t), _CORRELATED)


_WIDE = [f"e{i}" for i in range(16)]


@query(
    "wide_correlations",
    "A18",
    f"SELECT column_a, column_b, {r('r')} AS r FROM ({pairs_sql(_WIDE, '(SELECT ' + ', '.join(f'embedding[{i + 1}]::DOUBLE AS e{i}' for i in range(16)) + ' FROM embeddings)')})",
)
def wide_correlations(t: Tables) -> DataFrame:
    """Many columns: pair sums as matrix products over Arrow batches."""
    wide = t.embeddings.select(*[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(_WIDE)])
    return relation.correlations(wide, _WIDE)


@query(
    "strongest_correlation",
    "A18 A19",
    f"""WITH p AS ({pairs_sql(_CORRELATED, _CORR_SOURCE)}) SELECT (SELECT {r('max(abs(r))')} FROM p) AS max_abs_correlation,
    (SELECT {r('max(abs(r))')} FROM p WHERE 'l_extendedprice' IN (column_a, column_b)) AS target_correlation_max""",
)
def strongest_correlation(t: Tables) -> DataFrame:
    pairs = relation.correlations(correlated(t), _CORRELATED)
    with_target = (F.col("column_a") == "l_extendedprice") | (F.col("column_b") == "l_extendedprice")
    return pairs.agg(
        F.max(F.abs("r")).alias("max_abs_correlation"),
        F.max(F.when(with_target, F.abs("r"))).alias("target_correlation_max"),
    )


@query(
    "target_correlations",
    "A19",
    f"""SELECT CASE WHEN column_a = 'l_extendedprice' THEN column_b ELSE column_a END AS "column", {r('abs(r)')} AS abs_r
    FROM ({pairs_sql(_CORRELATED, _CORR_SOURCE)}) WHERE 'l_extendedprice' IN (column_a, column_b)""",
)
def target_correlations(t: Tables) -> DataFrame:
    return relation.target_correlations(relation.correlations(correlated(t), _CORRELATED), "l_extendedprice")


_SIX = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "discount_r", "price_twice"]


@query(
    "top_correlated_columns",
    "T9",
    f"""SELECT c AS "column", {r('sum(abs(r))')} AS weight FROM (SELECT column_a AS c, r FROM p UNION ALL SELECT column_b, r FROM p) GROUP BY 1 ORDER BY sum(abs(r)) DESC LIMIT 4""".replace(
        "FROM p", f"FROM ({pairs_sql(_SIX, _CORR_SOURCE)})"
    ),
)
def top_correlated_columns(t: Tables) -> DataFrame:
    matrix = relation.full_matrix(relation.correlations(correlated(t), _SIX), _SIX)
    return relation.top_correlated(matrix, 4).select(F.col("column_a").alias("column"), "weight")


@query(
    "correlation_matrix",
    "X10 T9",
    "SELECT column_a, " + ", ".join(
        f"{r(f'coalesce(max(CASE WHEN column_b = {chr(39)}{c}{chr(39)} THEN r END), 0)')} AS {c}" for c in _CORRELATED
    ) + f" FROM (SELECT * FROM p UNION ALL SELECT column_b, column_a, r FROM p UNION ALL SELECT c, c, 1.0 FROM (SELECT unnest({_CORRELATED}) AS c)) GROUP BY 1".replace(
        "FROM p", f"FROM ({pairs_sql(_CORRELATED, _CORR_SOURCE)})"
    ),
)
def correlation_matrix(t: Tables) -> DataFrame:
    matrix = relation.full_matrix(relation.correlations(correlated(t), _CORRELATED), _CORRELATED)
    return relation.dense_matrix(matrix, _CORRELATED)


# ---- mutual information ---------------------------------------------------------------


def mi_sql(source: str, target: str, number_target: bool, features: dict[str, str], bins: int = 16) -> str:
    """Plug-in information per feature; features map to number, text or time."""
    known = f"(SELECT * FROM {source} WHERE {target} IS NOT NULL)"
    parts = []
    for c, how in features.items():
        filled = {"number": f"coalesce({c}::DOUBLE, 0)", "text": f"coalesce({c}::VARCHAR, 'MISSING')",
                  "time": f"coalesce(epoch_us({c}), 4000000000000000000)"}[how]
        limit = "greatest(20, floor(0.05 * count(*) OVER ()))"
        distinct = "(max(dense) OVER ())"
        y = (f"CASE WHEN (max(ydense) OVER ()) > {limit} THEN (({bins} * (yrank - 1)) // count(*) OVER ())::VARCHAR ELSE y::VARCHAR END"
             if number_target else "y::VARCHAR")
        parts.append(
            f"""SELECT '{c}' AS "column", greatest(0.0, hx + hy - hxy) AS mi FROM (
            WITH raw AS (SELECT {filled} AS x, {target} AS y FROM {known}),
            ranked AS (SELECT x, y, rank() OVER (ORDER BY x) AS rnk, dense_rank() OVER (ORDER BY x) AS dense,
              rank() OVER (ORDER BY y) AS yrank, dense_rank() OVER (ORDER BY y) AS ydense FROM raw),
            cells AS (SELECT CASE WHEN {distinct} <= {bins} THEN x::VARCHAR ELSE (({bins} * (rnk - 1)) // count(*) OVER ())::VARCHAR END AS x, {y} AS y FROM ranked)
            SELECT (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) FROM (SELECT count(*) AS n FROM cells GROUP BY x)) AS hx,
              (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) FROM (SELECT count(*) AS n FROM cells GROUP BY y)) AS hy,
              (SELECT ln(sum(n)) - sum(n * ln(n)) / sum(n) FROM (SELECT count(*) AS n FROM cells GROUP BY x, y)) AS hxy)"""
        )
    return union_all(parts)


_ORDER_FEATURES = {"o_orderkey": "number", "o_custkey": "number", "o_totalprice": "number", "o_orderdate": "time", "o_orderpriority": "text"}
_DOC_FEATURES = {"doc_id": "number", "text": "text", "lang": "text", "source": "text", "n_chars": "number", "toxic": "number"}
_DOC_SOURCE = "(SELECT * FROM documents LEFT JOIN labels USING (doc_id))"


@query("information_with_class", "A20", f"SELECT \"column\", {r('mi')} AS mi FROM ({mi_sql('orders', 'o_orderstatus', False, _ORDER_FEATURES)})")
def information_with_class(t: Tables) -> DataFrame:
    return relation.mutual_information(t.orders, "o_orderstatus")


@query("information_with_gaps", "A20", f"SELECT \"column\", {r('mi')} AS mi FROM ({mi_sql(_DOC_SOURCE, 'quality', True, _DOC_FEATURES)})")
def information_with_gaps(t: Tables) -> DataFrame:
    """Rows without a target are left out; long texts are binned in sorted order."""
    return relation.mutual_information(t.documents.join(t.labels, "doc_id", "left"), "quality")


_LINE_FEATURES = {"l_quantity": "number", "l_discount": "number", "price_twice": "number", "tax_or_null": "number", "l_returnflag": "text", "l_shipdate": "time"}


@query(
    "information_with_number",
    "A20",
    f"SELECT \"column\", {r('mi')} AS mi FROM ({mi_sql(_CORR_SOURCE, 'l_extendedprice', True, _LINE_FEATURES)})",
)
def information_with_number(t: Tables) -> DataFrame:
    """A regression target is cut into equal-count bins too."""
    data = correlated(t).select("l_extendedprice", *_LINE_FEATURES)
    return relation.mutual_information(data, "l_extendedprice")


@query(
    "information_summary",
    "A20",
    f"SELECT {r('max(mi)')} AS target_mutual_information_max, {r('avg(mi)')} AS target_mutual_information_mean FROM ({mi_sql('orders', 'o_orderstatus', False, _ORDER_FEATURES)})",
)
def information_summary(t: Tables) -> DataFrame:
    return relation.information_summary(relation.mutual_information(t.orders, "o_orderstatus"))


# ---- vectors --------------------------------------------------------------------------


@query(
    "vector_distances",
    "M9 M10",
    f"""SELECT vec_id, {r("1 - d / (na * nb)")} AS cosine, {r("l2")} AS euclidean, {r("l1")} AS manhattan, {r("greatest(0, least(1, 1 - (1 - d / (na * nb)) / 2))")} AS similarity FROM (
    SELECT vec_id, list_dot_product(a, b) AS d, sqrt(list_dot_product(a, a)) AS na, sqrt(list_dot_product(b, b)) AS nb,
      list_distance(a, b) AS l2, list_sum(list_transform(list_zip(a, b), lambda z: abs(z[1] - z[2]))) AS l1
    FROM (SELECT vec_id, embedding::DOUBLE[] AS a, list_reverse(embedding)::DOUBLE[] AS b FROM embeddings))""",
)
def vector_distances(t: Tables) -> DataFrame:
    """Each vector against its own reverse."""
    pairs = t.embeddings.select(
        "vec_id", F.col("embedding").cast("array<double>").alias("a"), F.reverse("embedding").cast("array<double>").alias("b")
    )
    out = pairs.select("vec_id", *[distance(m, F.col("a"), F.col("b")).alias(m) for m in ("cosine", "euclidean", "manhattan")])
    return out.withColumn("similarity", similarity(F.col("cosine")))


def nearest_sql(metric: str, pool: str = "true", same: str = "true", k: int = 5, more: str = "") -> str:
    d = {
        "cosine": "1 - list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v)))",
        "euclidean": "list_distance(a.v, b.v)",
        "manhattan": "list_sum(list_transform(list_zip(a.v, b.v), lambda z: abs(z[1] - z[2])))",
    }[metric]
    return f"""SELECT query_id, rn::INTEGER AS rank, catalog_id, {r('d')} AS distance{more} FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 12), catalog_id) AS rn FROM (
      SELECT a.vec_id AS query_id, b.vec_id AS catalog_id, {d} AS d FROM (SELECT *, embedding::DOUBLE[] AS v FROM embeddings) a
      JOIN (SELECT *, embedding::DOUBLE[] AS v FROM embeddings WHERE {pool}) b ON a.vec_id <> b.vec_id AND {same})) WHERE rn <= {k}"""


@query("nearest_cosine", "J6 L11 W1", nearest_sql("cosine"))
def nearest_cosine(t: Tables) -> DataFrame:
    """The five nearest other vectors of every vector."""
    return nearest(t.embeddings, t.embeddings, query_id="vec_id", catalog_id="vec_id", vector="embedding", skip_self=True)


@query("nearest_euclidean", "J6 L11", nearest_sql("euclidean"))
def nearest_euclidean(t: Tables) -> DataFrame:
    """As above, with the catalog in blocks instead of a broadcast."""
    return nearest(
        t.embeddings, t.embeddings, metric="euclidean", query_id="vec_id", catalog_id="vec_id", vector="embedding",
        skip_self=True, broadcast_bytes=0,
    )


@query("nearest_same_label", "J6 L11 F7", nearest_sql("manhattan", same="a.label = b.label", k=3))
def nearest_same_label(t: Tables) -> DataFrame:
    """Neighbours restricted to the same task label."""
    return nearest(
        t.embeddings, t.embeddings, metric="manhattan", k=3, group="label", query_id="vec_id", catalog_id="vec_id",
        vector="embedding", skip_self=True,
    )


@query(
    "similar_datasets",
    "L11 F7 M10",
    nearest_sql("cosine", pool="label % 2 = 1 AND label < 6", more=f", {r('greatest(0, least(1, 1 - round(d, 12) / 2))')} AS similarity").replace("a.vec_id <> b.vec_id AND ", ""),
)
def similar_datasets_query(t: Tables) -> DataFrame:
    """Active catalog entries of one task type only."""
    catalog = t.embeddings.withColumn("is_active", F.col("label") < 6).withColumn(
        "task_type_code", F.when(F.col("label") % 2 == 1, "REGRESSION").otherwise("BINARY_CLASSIFICATION")
    )
    return similar_datasets(t.embeddings, catalog, "REGRESSION", query_id="vec_id", catalog_id="vec_id", vector="embedding")


@query(
    "padded_vectors",
    "X6 X7",
    f"SELECT vec_id, 128::INTEGER AS length, {r('list_sum(embedding::DOUBLE[])')} AS total, 0.0::DOUBLE AS last FROM embeddings",
)
def padded_vectors(t: Tables) -> DataFrame:
    padded = t.embeddings.select("vec_id", pad(F.col("embedding").cast("array<double>")).alias("v"))
    total = F.aggregate("v", F.lit(0.0), lambda s, x: s + x)
    return padded.select("vec_id", F.size("v").alias("length"), total.alias("total"), F.element_at("v", -1).alias("last"))


@query("feature_order_fingerprint", "X8", f"SELECT label, sha256('{','.join(FEATURE_ORDER)}') AS vector_order, count(*) AS n FROM embeddings GROUP BY 1")
def feature_order_fingerprint(t: Tables) -> DataFrame:
    return t.embeddings.groupBy("label").agg(F.first(order_fingerprint()).alias("vector_order"), F.count(F.lit(1)).alias("n"))


# ---- encodings ------------------------------------------------------------------------


@query(
    "standardised_numbers",
    "M3",
    f"""SELECT o_orderkey, {r("(o_totalprice - avg(o_totalprice) OVER ()) / stddev_pop(o_totalprice) OVER ()")} AS o_totalprice, 0.0::DOUBLE AS flat FROM orders""",
)
def standardised_numbers(t: Tables) -> DataFrame:
    data = t.orders.select("o_orderkey", "o_totalprice", F.lit(7.0).alias("flat"))
    return preparation.apply_scale(data, preparation.fit_scale(data, ["o_totalprice", "flat"]))


_LEVELS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


@query(
    "one_hot_levels",
    "M4",
    "SELECT o_orderkey, " + ", ".join(f"CASE WHEN p = '{v}' THEN 1 ELSE 0 END::INTEGER AS \"p_{v}\"" for v in _LEVELS)
    + " FROM (SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS p FROM orders)",
)
def one_hot_levels(t: Tables) -> DataFrame:
    """No level is dropped; a missing category gets none."""
    data = t.orders.select("o_orderkey", F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("p"))
    levels = [row["value"] for row in value_counts(data, ["p"]).orderBy("value").collect()]
    return preparation.one_hot(data, "p", "o_orderkey", levels)


@query("class_codes", "M5", "SELECT l AS label, (row_number() OVER (ORDER BY l) - 1)::INTEGER AS code FROM (SELECT DISTINCT p_brand AS l FROM part)")
def class_codes(t: Tables) -> DataFrame:
    return preparation.class_codes(t.part, "p_brand")


@query(
    "imputed_values",
    "M6 A31",
    f"""SELECT l_orderkey, l_linenumber, l_partkey, {r("coalesce(tax_or_null, (SELECT median(tax_or_null) FROM s))")} AS tax_or_null,
    coalesce(flag, (SELECT flag FROM s WHERE flag IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)) AS flag FROM s""".replace(
        " s", f" (SELECT *, CASE WHEN l_linestatus = 'F' THEN l_returnflag END AS flag FROM {GAPPY})"
    ),
)
def imputed_values(t: Tables) -> DataFrame:
    data = gappy(t).select("l_orderkey", "l_linenumber", "l_partkey", "tax_or_null", F.when(F.col("l_linestatus") == "F", F.col("l_returnflag")).alias("flag"))
    return preparation.impute(data, preparation.fill_values(data, ["tax_or_null"], ["flag"]))


@query("class_weights", "M12", f"SELECT event_type AS label, {r('(SELECT count(*) FROM events) / ((SELECT count(DISTINCT event_type) FROM events) * count(*))')} AS weight FROM events GROUP BY 1")
def class_weights(t: Tables) -> DataFrame:
    return preparation.class_weights(t.events, "event_type")


@query("class_distribution", "A30", "SELECT event_type AS label, count(*) AS n FROM events GROUP BY 1")
def class_distribution_query(t: Tables) -> DataFrame:
    return class_distribution(t.events, "event_type")


@query(
    "id_like_columns",
    "M11",
    union_all([f"SELECT '{c}' AS \"column\", (count(DISTINCT {c}) / count(*) > 0.5 OR round_even(count(DISTINCT {c}), 0) >= 30) AS id_like FROM {t}"
               for t, c in (("customer", "c_name"), ("customer", "c_mktsegment"), ("part", "p_name"), ("part", "p_brand"), ("part", "p_type"))]),
)
def id_like_columns(t: Tables) -> DataFrame:
    out = None
    for name, columns in (("customer", ["c_name", "c_mktsegment"]), ("part", ["p_name", "p_brand", "p_type"])):
        df = getattr(t, name)
        n = df.count()
        per = with_cardinality(entropies(distinct_counts(df, columns)), n)
        part = per.select("column", is_id_like(F.col("cardinality_ratio"), F.lit(n)).alias("id_like"))
        out = part if out is None else out.unionByName(part)
    return out


@query("first_rows", "S5 T1", "SELECT vec_id, label FROM embeddings ORDER BY vec_id LIMIT 10")
def first_rows(t: Tables) -> DataFrame:
    return page(t.embeddings, [F.asc("vec_id")], 1, 10).select("vec_id", "label")
