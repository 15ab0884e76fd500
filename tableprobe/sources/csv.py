"""CSV files: charset, delimiter, missing tokens and column types, all found by Spark jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tableprobe.functions.columns import ref

# Delimiters that are tried, in order of preference, and texts read as missing.
DELIMITERS = (",", ";", "\t", "|")
FALLBACK_CHARSET = "windows-1251"
MISSING_TOKENS = tuple(
    "|#N/A|#N/A N/A|#NA|-1.#IND|-1.#QNAN|-NaN|-nan|1.#IND|1.#QNAN|<NA>|N/A|NA|NULL|NaN|None|n/a|nan|null".split("|")
)


def file_charsets(spark: SparkSession, path: str, fallback: str = FALLBACK_CHARSET) -> DataFrame:
    """``(path, charset)``: UTF-8 where the whole file is valid UTF-8, else the fallback.

    The text reader hands over the bytes of a line as they are, so a large file is checked in
    pieces, line by line.
    """
    lines = spark.read.text(path)
    per_file = lines.select(F.col("_metadata.file_path").alias("path"), F.is_valid_utf8("value").alias("ok"))
    return per_file.groupBy("path").agg(
        F.when(F.bool_and("ok"), "UTF-8").otherwise(fallback).alias("charset")
    )


def file_delimiters(spark: SparkSession, path: str) -> DataFrame:
    """``(path, delimiter)``: the candidate that splits all lines into the most equal parts.

    A candidate must occur in every line on average once; the steadiest one wins, then the
    more frequent one, then the order of the candidates. A file with none gets a comma.
    """
    lines = spark.read.text(path).where(F.length(F.trim("value")) > 0)
    # Delimiters inside double quotes do not separate.
    bare = F.regexp_replace("value", '"[^"]*"', "")
    counted = lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.explode(
            F.array(
                *[
                    F.struct(
                        F.lit(i).alias("preference"),
                        F.lit(d).alias("delimiter"),
                        (F.length(bare) - F.length(F.replace(bare, F.lit(d), F.lit("")))).alias("n"),
                    )
                    for i, d in enumerate(DELIMITERS)
                ]
            )
        ).alias("c"),
    ).select("path", "c.*")
    scored = counted.groupBy("path", "preference", "delimiter").agg(
        F.avg("n").alias("mean"), F.var_pop("n").alias("spread")
    )
    order = Window.partitionBy("path").orderBy(
        F.desc(F.col("mean") >= 1), (F.col("spread") / F.greatest("mean", F.lit(1e-9))), F.desc("mean"), "preference"
    )
    best = scored.withColumn("k", F.row_number().over(order)).where(F.col("k") == 1)
    return best.select("path", F.when(F.col("mean") >= 1, F.col("delimiter")).otherwise(",").alias("delimiter"))


def files_with_quotes(spark: SparkSession, path: str) -> DataFrame:
    """``(path, escape, broken)``: how quotes inside fields are written, and whether records go over lines.

    Quotes stand doubled or behind a backslash, whichever the file has more often within a field. A record goes
    on if the quotes of some line do not balance.
    """
    value = F.col("value")
    quotes = F.length(value) - F.length(F.replace(value, F.lit('"'), F.lit("")))
    bare = F.replace(value, F.lit('\\"'), F.lit(""))
    bare_quotes = F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit("")))
    apart = r",;\t|"
    lines = spark.read.text(path).select(
        F.col("_metadata.file_path").alias("path"),
        F.regexp_count(value, F.lit(rf'\\"(?=[^{apart}])')).alias("behind"),
        F.regexp_count(value, F.lit(rf'[^{apart}]""[^{apart}]')).alias("doubled"),
        (quotes % 2 == 1).alias("odd"),
        (bare_quotes % 2 == 1).alias("bare_odd"),
    )
    behind = F.sum("behind") > F.sum("doubled")
    return lines.groupBy("path").agg(
        F.when(behind, "\\").otherwise('"').alias("escape"), F.when(behind, F.bool_or("bare_odd")).otherwise(F.bool_or("odd")).alias("broken")
    )


def read_text_table(
    spark: SparkSession,
    path: str | list[str],
    sep: str = ",",
    charset: str = "UTF-8",
    header: bool = True,
    names: list[str] | None = None,
    missing: tuple[str, ...] = MISSING_TOKENS,
    broken_lines: bool = False,
    escape: str = '"',
) -> DataFrame:
    """A CSV as text columns; fields that are exactly a missing token become NULL.

    ``broken_lines``: quoted fields hold line breaks. Such a file is read by one task. ``escape`` stands before
    a quote inside a field.

    ``sep=r"\\s+"`` splits at any run of blanks and needs ``names``.
    """
    if sep == r"\s+":
        if not names:
            raise ValueError("blank-separated files need column names")
        parts = F.split(F.trim("value"), r"\s+")
        decoded = F.decode(F.col("value").cast("binary"), charset).alias("value")
        lines = spark.read.text(path).select(decoded).where(F.length(F.trim("value")) > 0)
        raw = lines.select(*[F.get(parts, i).alias(n) for i, n in enumerate(names)])
    else:
        if charset.upper() not in ("UTF-8", "ISO-8859-1", "US-ASCII", "UTF-16", "UTF-16LE", "UTF-16BE", "UTF-32"):
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        reader = spark.read.option("sep", sep).option("encoding", charset).option("header", header)
        raw = reader.option("escape", escape).option("multiLine", broken_lines).csv(path)
        if names:
            raw = raw.toDF(*names)
    return raw.select(
        *[F.when(~ref(c).isin(*missing), ref(c)).alias(c) for c in raw.columns]
    )


def inferred_types(df: DataFrame) -> dict[str, str]:
    """bigint, double, boolean or string per text column, from one scan of all values.

    Dates stay text on purpose: a rule reports them.
    """
    kinds = ("bigint", "double", "boolean")

    def fits(c: str, kind: str) -> Column:
        text = F.trim(ref(c))
        if kind == "boolean":
            return F.lower(text).isin("true", "false")
        if kind == "bigint":
            return text.rlike(r"^[+-]?\d+$") & text.try_cast("bigint").isNotNull()
        return text.try_cast("double").isNotNull() & ~text.rlike(r"[dDfF]$")

    row = df.agg(
        *[F.count(ref(c)).alias(f"n{i}") for i, c in enumerate(df.columns)],
        *[F.count(F.when(fits(c, k), 1)).alias(f"{k}{i}") for i, c in enumerate(df.columns) for k in kinds],
    ).first()
    out = {}
    for i, c in enumerate(df.columns):
        n = row[f"n{i}"]
        out[c] = next((k for k in kinds if n and row[f"{k}{i}"] == n), "double" if not n else "string")
    return out


def typed(df: DataFrame, types: dict[str, str] | None = None) -> DataFrame:
    """Text columns cast to their (inferred) types."""
    types = types or inferred_types(df)
    return df.select(
        *[ref(c) if types[c] == "string" else F.trim(ref(c)).cast(types[c]).alias(c) for c in df.columns]
    )


def read_csv(spark: SparkSession, path: str, **options) -> DataFrame:
    """Files under ``path`` with charset, delimiter and quoting found per file, then types inferred.

    Files are grouped by (charset, delimiter, escape, quoted line breaks) and each group is one read.
    """
    found = file_charsets(spark, path).join(file_delimiters(spark, path), "path", "left")
    found = found.join(files_with_quotes(spark, path), "path", "left")
    groups: dict[tuple[str, str, str, bool], list[str]] = {}
    for r in found.collect():  # one row per file
        groups.setdefault((r["charset"], r["delimiter"] or ",", r["escape"] or '"', bool(r["broken"])), []).append(r["path"])
    if not groups:
        raise ValueError(f"no rows under {path}")
    tables = [
        read_text_table(spark, paths, sep=d, charset=c, escape=e, broken_lines=b, **options) for (c, d, e, b), paths in sorted(groups.items())
    ]
    return typed(reduce(lambda a, b: a.unionByName(b), tables))
