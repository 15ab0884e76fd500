"""The full profile of a table: every statistic over all of its rows."""

from __future__ import annotations

from collections.abc import Callable, Hashable
from dataclasses import dataclass
from threading import Lock

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tableprobe.functions.columns import column_groups, nan_to_null, ref
from tableprobe.functions.dates import date_share
from tableprobe.operators import categorical, distribution, normality, numeric, order_stats, relation, states, structure, target as target_ops
from tableprobe.session import cut_lineage, spread, together
from tableprobe.sources.store import check_target


@dataclass
class Profile:
    """The parts of a profile; every part is a DataFrame keyed by ``dataset``."""

    table: DataFrame  # one row
    columns: DataFrame  # one row per column
    correlations: DataFrame  # one row per pair of numeric columns
    histograms: DataFrame  # one row per numeric column and bin
    categories: DataFrame  # top values of the category columns
    classes: DataFrame  # class counts of a class target
    cached: DataFrame | None = None

    def release(self) -> None:
        """Drop the cached copy of a small table."""
        if self.cached is not None and self.cached.is_cached:
            self.cached.unpersist()


class Shared:
    """What profiles of one table with other targets have in common; each part is computed once."""

    def __init__(self, several: bool = False):
        self.several = several  # more than one profile will ask
        self._lock, self._locks, self._found = Lock(), {}, {}

    def once(self, part: Hashable, compute: Callable[[], object]):
        with self._lock:
            lock = self._locks.setdefault(part, Lock())
        with lock:
            if part not in self._found:
                self._found[part] = compute()
            return self._found[part]


def text_date_shares(df: DataFrame, columns: list[str]) -> DataFrame:
    """``(column, date_share)`` of the text columns over all their values, in one scan."""
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, date_share double")
    one = df.agg(*[date_share(ref(c)).alias(f"d{i}") for i, c in enumerate(columns)])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"d{i}").alias("date_share")) for i, c in enumerate(columns)]
    return one.select(F.inline(F.array(*rows)))


def profile(
    df: DataFrame,
    dataset: str,
    target: str | None = None,
    key: str | None = None,
    original_rows: int | None = None,
    shared_parts: Shared | None = None,
) -> Profile:
    """Profile ``df``; ``key`` is kept for callers and has no influence.

    ``shared_parts`` is given to all profiles of one table that differ in their target only.

    The table is scanned for its sizes, once for a state of all numbers (moments, co-moments, values of columns that
    have few, first digits of ranks), for duplicates and for value counts; then for the digits that ranks still
    lack, once for outliers and histograms together, and once for information with the target. Independent scans
    run side by side. The driver sees a few numbers per column, never rows of the table.
    """
    check_target(df, target)
    spark = df.sparkSession
    common = shared_parts or Shared()
    data = common.once("data", lambda: spread(nan_to_null(df)))
    everything, features = column_groups(data), column_groups(data, target)
    numbers, categories, times = everything["numeric"], everything["categorical"], features["datetime"]
    texts = [f.name for f in data.schema.fields if f.dataType.simpleString() == "string"]
    digits = [*numbers, *times]
    counted = everything["categorical"] if common.several else categories
    as_numbers = data.select(*[ref(c) for c in numbers], *[relation.micros(c).alias(c) for c in times])

    def number_states() -> dict:
        """One scan of all numbers, and what its states say."""
        if not digits:
            return {"rows": None, "moments": {}, "few": {}, "pairs": spark.createDataFrame([], PAIR_FIELDS)}
        collectors = [states.Moments(), states.CoMoments(len(numbers)), states.Few(len(digits), relation.MI_BINS), order_stats.first_cells(digits)]
        rows = cut_lineage(states.scan(as_numbers, digits, collectors))
        found = together(
            {
                "moments": lambda: states.moments_of(rows, digits),
                "few": lambda: states.few_of(rows, digits, relation.MI_BINS),
                "pairs": lambda: cut_lineage(states.correlations_of(rows, numbers)) if len(numbers) > 1 else spark.createDataFrame([], PAIR_FIELDS),
            }
        )
        return {"rows": rows, **found}

    first = together(
        {
            "sizes": lambda: common.once("sizes", lambda: _sizes(data, texts)),
            "numbers": lambda: common.once(("numbers", *digits), number_states),
            "copies": lambda: common.once("copies", lambda: structure.duplicates(data).first()),
            # The value counts feed entropy, cardinality and the category tables: computed once.
            "counts": lambda: common.once("counts", lambda: cut_lineage(categorical.distinct_counts(data, counted))),
            "facts": lambda: target_ops.target_stats(data, [target]).first() if target else None,
        }
    )
    sizes, state, counts, facts = first["sizes"], first["numbers"], first["counts"], first["facts"]
    if counted != categories:
        counts = counts.where(F.col("column").isin(categories))
    n_rows, by_moment, pairs = sizes["n_rows"], state["moments"], state["pairs"]
    moment_rows = [by_moment[c] for c in numbers]
    normal = normality.of_moments(numeric.moment_table(spark, [by_moment[c] for c in features["numeric"]])) if features["numeric"] else None
    gaps = {c: n_rows - by_moment[c]["n_finite"] for c in digits}
    # The information is over rows with a target; where all rows have one, the states above are its own.
    shared = target is not None and sizes["present"][target] == n_rows and n_rows > 1
    shared = shared and all(sizes["present"][c] == by_moment[c]["n_finite"] for c in digits)
    binned = shared and target in numbers and facts["target_kind"] == "regression"
    quarters = (0.25, 0.75)
    measured = numbers if common.several else features["numeric"]

    def in_bins(c: str) -> bool:
        return shared and (c != target or binned)

    def all_ranks() -> tuple[dict, dict[str, list]]:
        """Values at the quartiles of numbers and at the edges of bins, and which ranks the edges are."""
        plan: dict[str, list] = {}

        def ranks_of(c: str, n: int, negative: int) -> list[int]:
            wanted = order_stats.quantile_ranks(n, quarters) if c in measured else []
            if common.several or in_bins(c):
                plan[c], more = relation.filled_ranks(c, n, negative, gaps[c], c in times, relation.MI_BINS)
                wanted = wanted + more
            return wanted

        return order_stats.select_ranks(as_numbers, ranks_of, digits, state["rows"]), plan

    second = together(
        {
            "ranks": lambda: common.once(("ranks", *digits), all_ranks),
            "normal": lambda: normal.collect() if normal is not None else [],
            "entropy": lambda: categorical.entropies(counts).collect(),
            "strongest": lambda: pairs.agg(F.max(F.abs("r"))).first()[0],
            "with_target": lambda: dict(relation.target_correlations(pairs, target).collect()) if target in numbers else {},
        }
    )
    ranks, plan = second["ranks"]
    fence_of = {c: numeric.fence(*[order_stats.quantile(ranks[c][0], ranks[c][2], q) for q in quarters]) for c in measured}
    entropy_of = {x["column"]: x for x in second["entropy"]}
    test_of = {x["column"]: x for x in second["normal"]}

    def information() -> dict:
        if not target:
            return {}
        known = None
        if shared:
            few = {c for c, v in state["few"].items() if c != target and v is not None and len({*v, *([0.0] if gaps[c] else [])}) <= relation.MI_BINS}
            others = [c for c in features["categorical"]]
            distinct = {c: (entropy_of[c]["n_distinct"] if c in entropy_of else 0) + (sizes["present"][c] < n_rows) for c in others}
            few |= {c for c in others if distinct[c] <= relation.MI_BINS}
            edges = {c: [v if r is None else ranks[c][2][r] for v, r in e] for c, e in plan.items() if in_bins(c)}
            known = relation.BinFacts(few, edges, binned)
        return dict(relation.mutual_information(data, target, known_facts=known).collect())

    third = together({"marks": lambda: common.once("marks", lambda: _marks(data, numbers, by_moment, fence_of)), "information": information})
    marks, information_of = third["marks"], third["information"]

    # From here on tables have one row per column (or pair of columns) of the profiled table.
    with_target = second["with_target"]
    rows = []
    for i, field in enumerate(data.schema.fields):
        c = field.name
        kind = next(k for k, names in everything.items() if c in names)
        feature = c != target
        number = feature and kind == "numeric"
        moment = by_moment.get(c) if number else None
        test = test_of.get(c)
        entropy = entropy_of.get(c) if feature else None
        category = feature and kind == "categorical"
        n_distinct = entropy["n_distinct"] if entropy else (0 if category else None)
        n_outliers = marks[c]["z" if test and test["is_normal"] else "iqr"] if number else None
        rows.append(
            (
                dataset, c, i, field.dataType.simpleString(), kind, not feature,
                n_rows - sizes["present"][c],
                (n_rows - sizes["present"][c]) / max(n_rows, 1),
                *([moment[k] for k in MOMENTS] if moment else [None] * len(MOMENTS)),
                test["p_value"] if test else None,
                test["is_normal"] if test else None,
                n_outliers,
                n_outliers / max(moment["n_finite"], 1) if number else None,
                n_distinct,
                entropy["entropy"] if entropy else None,
                entropy["normalized_entropy"] if entropy else None,
                n_distinct / max(n_rows, 1) if category else None,
                sizes["dates"].get(c),
                with_target.get(c),
                information_of.get(c),
            )
        )
    per_column = spark.createDataFrame(rows, COLUMN_FIELDS)
    table = _table_row(spark, dataset, target, n_rows, sizes, first["copies"], facts, per_column, second["strongest"], information_of, with_target)
    name = F.lit(dataset).alias("dataset")
    top = categorical.top_with_rest(counts)
    long_texts = [c for c in texts if (sizes["longest"][c] or 0) > categorical.LONG_TEXT]
    if long_texts:
        top = categorical.with_long_texts(cut_lineage(top), data, long_texts)
    classes = (
        target_ops.class_counts(data, target)
        if target and facts["target_kind"] == "categorical"
        else spark.createDataFrame([], "label string, n long")
    )
    table = table.withColumn(
        "original_rows", F.lit(original_rows).cast("long") if original_rows is not None else F.col("n_rows")
    ).withColumn("type_counts", F.create_map(
        *[x for k, v in structure.type_counts(data).items() for x in (F.lit(k), F.lit(v).cast("long"))]
    ).cast("map<string,bigint>"))
    return Profile(
        table=table,
        columns=per_column,
        correlations=pairs.select(name, "*"),
        histograms=distribution.histogram_rows(spark, distribution.bin_ranges(moment_rows), {c: m["bins"] for c, m in marks.items()}).select(name, "*"),
        categories=top.select(name, "*"),
        classes=classes.select(name, "*"),
        cached=data,
    )


def _marks(data: DataFrame, numbers: list[str], by_moment: dict, fence_of: dict) -> dict[str, dict]:
    """Outliers by both methods and histogram counts of every number, in one scan."""
    if not numbers:
        return {}
    ranges = distribution.bin_ranges([by_moment[c] for c in numbers])
    centres = [(by_moment[c]["mean"], by_moment[c]["std"]) if by_moment[c]["n_finite"] else None for c in numbers]
    collector = states.Marks([fence_of.get(c) for c in numbers], centres, [ranges.get(c) for c in numbers], distribution.BINS, numeric.Z_LIMIT)
    found = states.one_state(states.scan(data, numbers, [collector]), states.Marks, (len(numbers), 2 + distribution.BINS))
    return {c: {"iqr": int(s[0]), "z": int(s[1]), "bins": s[2:].astype(int).tolist()} for c, s in zip(numbers, found)}


def _sizes(data: DataFrame, texts: list[str]) -> dict:
    """Rows, bytes, present values and date shares of all columns in one scan."""
    row = structure.structure_aggregates(data)
    columns = data.columns
    found = data.agg(
        *row,
        *[F.count(ref(c)).alias(f"present_{i}") for i, c in enumerate(columns)],
        *[date_share(ref(c)).alias(f"date_{i}") for i, c in enumerate(texts)],
        *[F.max(F.length(ref(c))).alias(f"longest_{i}") for i, c in enumerate(texts)],
    ).first()
    return {
        "n_rows": found["n_rows"],
        "memory_mb": found["memory_mb"],
        "present": {c: found[f"present_{i}"] for i, c in enumerate(columns)},
        "longest": {c: found[f"longest_{i}"] for i, c in enumerate(texts)},
        "dates": {c: found[f"date_{i}"] for i, c in enumerate(texts)},
    }


def _table_row(spark, dataset, target, n_rows, sizes, copies, facts, per_column, strongest, information, with_target) -> DataFrame:
    """The one-row table of a profile."""
    cells = n_rows * len(sizes["present"])
    missing = {c: n_rows - present for c, present in sizes["present"].items()}
    tied = [v for v in with_target.values() if v is not None]
    known = list(information.values())
    facts = facts.asDict() if facts else {}
    base = spark.createDataFrame(
        [
            (
                dataset, n_rows, len(sizes["present"]), sizes["memory_mb"], target,
                sum(missing.values()) / (cells or 1),
                max((m / max(n_rows, 1) for m in missing.values()), default=0.0),
                copies["n_duplicates"], copies["duplicate_rows_pct"],
                strongest, max(tied, default=None), max(known, default=None),
                sum(known) / len(known) if known else None,
                *[facts.get(f.split(" ")[0]) for f in TARGET_FIELDS.split(", ")],
            )
        ],
        TABLE_FIELDS + ", " + TARGET_FIELDS,
    )
    rolled = numeric.numeric_summary(per_column.where((F.col("kind") == "numeric") & ~F.col("is_target")))
    return base.join(rolled.withColumn("dataset", F.lit(dataset)), "dataset", "left")


# Rows per column are few, so the local results above become small tables again.
MOMENTS = ("n_finite", "mean", "std", "skewness", "kurtosis", "min", "max")
PAIR_FIELDS = "column_a string, column_b string, r double"
COLUMN_FIELDS = (
    "dataset string, column string, position int, type string, kind string, is_target boolean, n_missing long, missing_pct double, "
    "n_finite long, mean double, std double, skewness double, kurtosis double, min double, max double, p_value double, is_normal boolean, "
    "n_outliers long, outliers_pct double, n_distinct long, entropy double, normalized_entropy double, cardinality_ratio double, "
    "date_share double, target_abs_r double, target_mi double"
)
TABLE_FIELDS = (
    "dataset string, n_rows long, n_cols long, memory_mb double, target_column string, total_missing_pct double, max_col_missing_pct double, "
    "n_duplicates long, duplicate_rows_pct double, max_abs_correlation double, target_correlation_max double, "
    "target_mutual_information_max double, target_mutual_information_mean double"
)
TARGET_FIELDS = (
    "target_kind string, target_n_unique long, target_imbalance_ratio double, target_class_entropy double, "
    "target_skewness double, min_class_size long, min_class string, all_number_labels boolean"
)
