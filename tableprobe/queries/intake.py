"""Queries for reading, typing and storing tables, and for filters on columns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tableprobe.functions.columns import column_groups, is_number_label, json_number, json_safe, ref, safe_double
from tableprobe.functions.scalars import features_to_rows
from tableprobe.operators.preparation import cardinality, modelling_columns
from tableprobe.operators.service import among, matching
from tableprobe.plans.fleet import Source, analyse, profile_fleet
from tableprobe.plans.rules import default_rules
from tableprobe.queries.registry import Tables, query, r, scratch, union_all
from tableprobe.queries.statistics import DOC_LABELS, documents_with_labels
from tableprobe.sources import csv as csv_source
from tableprobe.sources import store

LIST_ROWS = 10_000  # records of one JSON list

_ORDERS_TEXT = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority"


def orders_with_text_date(t: Tables) -> DataFrame:
    return t.orders.withColumn("o_orderdate", F.date_format("o_orderdate", "yyyy-MM-dd"))


@query("csv_scan", "S1 S2", f"SELECT {_ORDERS_TEXT} FROM orders")
def csv_scan(t: Tables) -> DataFrame:
    """orders written as semicolon CSV, read back with delimiter and types found from the files."""
    path = scratch(t.spark)
    orders_with_text_date(t).write.option("header", True).option("sep", ";").csv(path)
    return csv_source.read_csv(t.spark, path)


@query("csv_without_header", "S1 S2", "SELECT p_partkey AS id, CASE WHEN p_size < 10 THEN NULL ELSE p_size END::BIGINT AS size, p_brand AS brand FROM part")
def csv_without_header(t: Tables) -> DataFrame:
    """No header, names given, ``?`` as missing."""
    path = scratch(t.spark)
    size = F.when(F.col("p_size") < 10, F.lit("?")).otherwise(F.col("p_size").cast("string"))
    t.part.select("p_partkey", size.alias("p_size"), "p_brand").write.option("sep", "|").csv(path)
    raw = csv_source.read_text_table(t.spark, path, sep="|", header=False, names=["id", "size", "brand"], missing=(*csv_source.MISSING_TOKENS, "?"))
    return csv_source.typed(raw)


@query("csv_with_line_breaks", "S1 S2", "SELECT doc_id, text, lang FROM documents")
def csv_with_line_breaks(t: Tables) -> DataFrame:
    """Documents with their line breaks and quotes, in quoted fields, beside files without any."""
    path = scratch(t.spark)
    quoted = t.documents.select("doc_id", "text", "lang").write.option("header", True).option("escape", '"').option("quoteAll", True)
    quoted.csv(path)
    return csv_source.read_csv(t.spark, path)


@query("json_of_both_kinds", "S7", f"SELECT event_id, event_type, {r('value')} AS value FROM events")
def json_of_both_kinds(t: Tables) -> DataFrame:
    """One folder with files of records per line and files of one list each, of about LIST_ROWS records."""
    path = scratch(t.spark)
    events = t.events.select("event_id", "event_type", "value")
    store.write_records(events.where("event_id % 2 = 0"), f"{path}/lines")
    odd = events.where("event_id % 2 != 0 or event_id is null")
    lists = max(2, -(-odd.count() // LIST_ROWS))
    bucket = F.pmod(F.xxhash64(*events.columns), F.lit(lists)).alias("bucket")
    one = odd.groupBy(bucket).agg(F.to_json(F.collect_list(F.struct(*events.columns))).alias("value"))
    one.select("value").write.option("maxRecordsPerFile", 1).text(f"{path}/lists")
    return store.read_records(t.spark, f"{path}/*", "event_id long, event_type string, value double")


@query("blank_separated_scan", "S1 S2", f"SELECT s_suppkey AS id, s_name AS name, {r('s_acctbal')} AS balance FROM supplier")
def blank_separated_scan(t: Tables) -> DataFrame:
    """Columns separated by runs of blanks."""
    path = scratch(t.spark)
    t.supplier.select(F.concat_ws("   ", "s_suppkey", "s_name", "s_acctbal")).write.text(path)
    raw = csv_source.read_text_table(t.spark, path, sep=r"\s+", names=["id", "name", "balance"])
    return csv_source.typed(raw)


@query(
    "inferred_types",
    "S2",
    """SELECT * FROM (VALUES ('o_orderkey', 'bigint'), ('o_custkey', 'bigint'), ('o_orderstatus', 'string'), ('o_totalprice', 'double'),
    ('o_orderdate', 'string'), ('o_orderpriority', 'string'), ('is_open', 'boolean')) v("column", "type")""",
)
def inferred_types(t: Tables) -> DataFrame:
    path = scratch(t.spark)
    data = orders_with_text_date(t).withColumn("is_open", F.col("o_orderstatus") == "O")
    data.write.option("header", True).csv(path)
    types = csv_source.inferred_types(csv_source.read_text_table(t.spark, path))
    return t.spark.createDataFrame(list(types.items()), "column string, type string")


@query(
    "file_delimiters",
    "S3",
    """SELECT * FROM (VALUES ('comma', ','), ('semicolon', ';'), ('tab', chr(9)), ('bar', '|'), ('single', ',')) v(kind, delimiter)""",
)
def file_delimiters(t: Tables) -> DataFrame:
    """The delimiter of every file, found from all its lines."""
    path = scratch(t.spark)
    for kind, sep in (("comma", ","), ("semicolon", ";"), ("tab", "\t"), ("bar", "|")):
        orders_with_text_date(t).write.option("sep", sep).option("header", True).csv(f"{path}/kind={kind}")
    t.orders.select("o_orderkey").write.option("header", True).csv(f"{path}/kind=single")
    found = csv_source.file_delimiters(t.spark, f"{path}/*")
    return found.select(F.regexp_extract("path", "kind=([a-z]+)", 1).alias("kind"), "delimiter").distinct()


@query(
    "file_charsets",
    "S4",
    """SELECT 'utf8' AS kind, 'UTF-8' AS charset, count(*) AS n FROM documents UNION ALL
    SELECT 'latin', 'ISO-8859-1', count(*) FROM documents WHERE text SIMILAR TO '(.|\\n)*[éèêàçù](.|\\n)*' AND lang = 'fr'""",
)
def file_charsets(t: Tables) -> DataFrame:
    """Files that are not valid UTF-8 get the fallback charset and read back unchanged."""
    path = scratch(t.spark)
    flat = t.documents.select("doc_id", F.regexp_replace("text", r"\s+", " ").alias("text"), "lang")
    french = flat.where((F.col("lang") == "fr") & F.col("text").rlike("[éèêàçù]"))
    for kind, rows, charset in (("utf8", flat, "UTF-8"), ("latin", french, "ISO-8859-1")):
        writer = rows.select("doc_id", "text").write.option("sep", "\t").option("escape", '"')
        writer.option("encoding", charset).csv(f"{path}/kind={kind}")
    found = csv_source.file_charsets(t.spark, f"{path}/*", fallback="ISO-8859-1")
    kinds = found.select(F.regexp_extract("path", "kind=([a-z0-9]+)", 1).alias("kind"), "charset").distinct()
    out = None
    for kind, charset in sorted(tuple(x) for x in kinds.collect()):
        raw = csv_source.read_text_table(
            t.spark, f"{path}/kind={kind}", sep="\t", charset=charset, header=False, names=["doc_id", "text"]
        )
        same = raw.join(flat.select(F.col("doc_id").cast("string"), F.col("text").alias("original")), "doc_id")
        part = same.where(F.trim("text") == F.trim("original")).agg(
            F.lit(kind).alias("kind"), F.lit(charset).alias("charset"), F.count(F.lit(1)).alias("n")
        )
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "preview_rows",
    "S5",
    "SELECT o_orderkey, o_orderstatus, o_totalprice, o_orderpriority FROM orders ORDER BY o_orderkey LIMIT 100",
)
def preview_rows(t: Tables) -> DataFrame:
    return store.preview(t.orders.select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderpriority"), [F.asc("o_orderkey")])


@query("table_shape", "S5", "SELECT 'orders' AS \"table\", count(*) AS n_rows, 6::BIGINT AS n_cols FROM orders")
def table_shape(t: Tables) -> DataFrame:
    return store.shape(t.orders).withColumn("table", F.lit("orders"))


@query("checked_target", "S6", "SELECT 'refused' AS unknown, count(l_tax) AS n FROM lineitem")
def checked_target(t: Tables) -> DataFrame:
    """An unknown target is refused before any job starts, a known one is used."""
    try:
        store.check_target(t.lineitem, "no_such_column")
        verdict = "accepted"
    except ValueError:
        verdict = "refused"
    store.check_target(t.lineitem, "l_tax")
    return t.lineitem.agg(F.lit(verdict).alias("unknown"), F.count("l_tax").alias("n"))


@query("json_records", "S7", f"SELECT event_id, event_type, {r('value')} AS value, props FROM events")
def json_records(t: Tables) -> DataFrame:
    """Records written as JSON and read back."""
    path = scratch(t.spark)
    store.write_records(t.events.select("event_id", "event_type", "value", "props"), path)
    return store.read_records(t.spark, path, "event_id long, event_type string, value double, props string")


@query(
    "json_safe_numbers",
    "S8",
    f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN {r('o_totalprice')} END AS price,
    '{{"share":' || CASE WHEN o_orderstatus = 'O' THEN 'null' ELSE '1.5' END || ',"list":[' || CASE WHEN o_orderstatus = 'P' THEN 'null' ELSE '0.5' END || ',2.0]}}' AS nested FROM orders""",
)
def json_safe_numbers(t: Tables) -> DataFrame:
    """NaN and infinities become null in plain, nested and listed numbers."""
    status = F.col("o_orderstatus")
    price = F.when(status == "F", F.col("o_totalprice")).when(status == "O", F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    share = F.when(status == "O", F.lit(float("-inf"))).otherwise(F.lit(1.5))
    items = F.array(F.when(status == "P", F.lit(float("nan"))).otherwise(F.lit(0.5)), F.lit(2.0))
    data = t.orders.select("o_orderkey", price.alias("price"), F.struct(share.alias("share"), items.alias("list")).alias("nested"))
    return json_safe(data).withColumn("nested", F.to_json("nested", {"ignoreNullFields": "false"}))


@query(
    "fleet_profiles",
    "S9",
    union_all([f"SELECT '{t}' AS title, count(*) AS n_rows, {n}::BIGINT AS n_cols, '' AS error FROM {t}" for t, n in (("region", 2), ("nation", 3), ("supplier", 4))])
    + " UNION ALL SELECT 'missing', NULL, NULL, 'failed'",
)
def fleet_profiles(t: Tables) -> DataFrame:
    """Two runs over a fleet: the second skips what is stored; a broken source is noted."""
    sources = [Source(n, lambda n=n: getattr(t, n)) for n in ("region", "nation")]
    first, _ = profile_fleet(t.spark, sources)
    sources += [Source("supplier", lambda: t.supplier), Source("missing", lambda: getattr(t, "no_such_table"))]
    rows, errors = profile_fleet(t.spark, sources, stored=first)
    done = rows.select("title", "n_rows", "n_cols", F.lit("").alias("error"))
    failed = errors.select("title", F.lit("failed").alias("error"))
    return done.unionByName(failed, allowMissingColumns=True)


@query(
    "stored_results",
    "S10 P7",
    """SELECT 'labels' AS dataset, count(*) AS n_rows, 3::BIGINT AS n_cols, 1::BIGINT AS n_results FROM labels
    UNION ALL SELECT 'supplier', count(*), 4, 1 FROM supplier""",
)
def stored_results(t: Tables) -> DataFrame:
    """Runs stored side by side; storing a dataset again replaces its older result."""
    path = scratch(t.spark)
    rules = default_rules(t.spark)
    for name, target in (("supplier", None), ("labels", "quality"), ("labels", "toxic")):
        analyse(getattr(t, name), name, rules, target, store=path)
    results = store.load_results(t.spark, path, "results")
    return results.groupBy("dataset").agg(
        F.max("n_rows").alias("n_rows"), F.max("n_cols").alias("n_cols"), F.count(F.lit(1)).alias("n_results")
    )


_TYPED = ["lineitem", "orders", "customer", "part", "events", "documents", "labels", "conversations"]


@query(
    "column_groups",
    "F1 F2",
    f"""SELECT table_name AS "table", column_name AS "column", CASE WHEN data_type LIKE 'TIMESTAMP%' OR data_type = 'DATE' THEN 'datetime'
    WHEN data_type IN ('BIGINT', 'INTEGER', 'DOUBLE', 'FLOAT') THEN 'numeric' ELSE 'categorical' END AS kind
    FROM information_schema.columns WHERE table_name IN ({", ".join(f"'{x}'" for x in _TYPED)}) AND column_name <> 'l_tax'""",
)
def column_groups_query(t: Tables) -> DataFrame:
    """Every column in one group; the target of lineitem is left out."""
    rows = []
    for name in _TYPED:
        groups = column_groups(getattr(t, name), "l_tax" if name == "lineitem" else None)
        rows += [(name, c, kind) for kind, columns in groups.items() for c in columns]
    return t.spark.createDataFrame(rows, "table string, column string, kind string")


@query("known_target_rows", "F4", f"SELECT lang, count(*) AS n FROM {DOC_LABELS} WHERE quality IS NOT NULL GROUP BY lang")
def known_target_rows(t: Tables) -> DataFrame:
    data = documents_with_labels(t).where(ref("quality").isNotNull())
    return data.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query(
    "modelling_columns",
    "F5",
    """SELECT * FROM (SELECT 'customer' AS "table", 'c_mktsegment' AS "column", count(DISTINCT c_mktsegment) / count(*) < 0.1 AS keep FROM customer
    UNION ALL SELECT 'customer', 'c_name', count(DISTINCT c_name) / count(*) < 0.1 FROM customer
    UNION ALL SELECT 'customer', 'c_nationkey', true UNION ALL SELECT 'customer', 'c_acctbal', false
    UNION ALL SELECT 'orders', 'o_custkey', true UNION ALL SELECT 'orders', 'o_orderpriority', count(DISTINCT o_orderpriority) / count(*) < 0.1 FROM orders
    UNION ALL SELECT 'orders', 'o_totalprice', false) WHERE keep""",
)
def modelling_columns_query(t: Tables) -> DataFrame:
    """Target, key, leaks, times and near-ids are left out."""
    rows = []
    for name, target, key, leaks in (("customer", "c_acctbal", "c_custkey", []), ("orders", "o_orderstatus", "o_orderkey", ["o_totalprice"])):
        df = getattr(t, name)
        ratios = cardinality(df, column_groups(df, target)["categorical"])
        for columns in modelling_columns(df, target, leaks, ratios, key).values():
            rows += [(name, c, True) for c in columns]
    return t.spark.createDataFrame(rows, "table string, column string, keep boolean")


@query(
    "owner_and_status_filter",
    "F6",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
)
def owner_and_status_filter(t: Tables) -> DataFrame:
    return matching(t.orders, o_orderstatus="F", o_orderpriority="1-URGENT").select("o_orderkey", "o_totalprice")


@query(
    "optional_filter",
    "F7",
    """SELECT 'set' AS parameter, count(*) AS n FROM embeddings WHERE 3 IS NULL OR label = 3
    UNION ALL SELECT 'unset', count(*) FROM embeddings""",
)
def optional_filter(t: Tables) -> DataFrame:
    def counted(name: str, value: int | None) -> DataFrame:
        return matching(t.embeddings, label=value).agg(F.lit(name).alias("parameter"), F.count(F.lit(1)).alias("n"))

    return counted("set", 3).unionByName(counted("unset", None))


@query(
    "membership_filter",
    "F8",
    """SELECT 'list' AS kind, count(*) AS n FROM orders WHERE o_orderstatus IN ('F', 'P')
    UNION ALL SELECT 'table', count(*) FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')""",
)
def membership_filter(t: Tables) -> DataFrame:
    listed = among(t.orders, "o_orderstatus", ["F", "P"])
    keyed = among(t.orders, "o_custkey", t.customer.where("c_mktsegment = 'BUILDING'").select("c_custkey"))
    parts = [df.agg(F.lit(k).alias("kind"), F.count(F.lit(1)).alias("n")) for k, df in (("list", listed), ("table", keyed))]
    return parts[0].unionByName(parts[1])


_LABELS = "(SELECT p_brand AS v FROM part UNION ALL SELECT ' ' || p_size::VARCHAR || ' ' FROM part UNION ALL SELECT p_retailprice::VARCHAR FROM part UNION ALL SELECT CASE WHEN p_size < 20 THEN 'nan' ELSE 'inf' END FROM part)"


@query(
    "number_labels",
    "F9",
    f"SELECT v IN ('nan', 'inf') AS special, v LIKE 'Brand%' AS brand, coalesce(isfinite(try_cast(trim(v) AS DOUBLE)), false) AS is_number, count(*) AS n FROM {_LABELS} GROUP BY ALL",
)
def number_labels(t: Tables) -> DataFrame:
    p = t.part
    texts = p.select(F.col("p_brand").alias("v"))
    texts = texts.unionByName(p.select(F.concat(F.lit(" "), F.col("p_size").cast("string"), F.lit(" ")).alias("v")))
    texts = texts.unionByName(p.select(F.col("p_retailprice").cast("string").alias("v")))
    texts = texts.unionByName(p.select(F.when(F.col("p_size") < 20, "nan").otherwise("inf").alias("v")))
    marked = texts.select(
        F.col("v").isin("nan", "inf").alias("special"), F.col("v").like("Brand%").alias("brand"), is_number_label(F.col("v")).alias("is_number")
    )
    return marked.groupBy("special", "brand", "is_number").agg(F.count(F.lit(1)).alias("n"))


@query(
    "safe_numbers",
    "M7 M8",
    f"""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN {r('o_totalprice')} ELSE 0.0 END AS price, 0.0::DOUBLE AS word, {r("2 / greatest(o_custkey, 1)")} AS ratio FROM orders""",
)
def safe_numbers(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    price = F.when(status == "F", F.col("o_totalprice")).when(status == "O", F.lit(float("nan"))).otherwise(F.lit(float("inf")))
    return t.orders.select(
        "o_orderkey",
        safe_double(price).alias("price"),
        safe_double(F.col("o_orderpriority")).alias("word"),
        features_to_rows(F.lit(2), F.col("o_custkey")).alias("ratio"),
    )


@query("json_number_scalar", "S8", f"SELECT event_type, count(*) AS n, {r('sum(value)')} AS total FROM events WHERE value >= 5 GROUP BY 1")
def json_number_scalar(t: Tables) -> DataFrame:
    spoiled = F.when(F.col("value") < 5, F.lit(float("nan"))).otherwise(F.col("value"))
    clean = t.events.select("event_type", json_number(spoiled).alias("x")).where(F.col("x").isNotNull())
    return clean.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("total"))
