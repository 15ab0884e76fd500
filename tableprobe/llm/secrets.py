"""Secret scans with corpus-wide ownership frequency, in DataFrame functions only.

Patterns find candidates in whole texts. Each candidate's value is hashed and counted over the
whole corpus: in how many distinct repositories and under how many distinct owners it occurs. A
value that many owners have copied is an example from documentation; one that a single owner has
(a few repositories at most) and that looks random is live-looking. The values that turn out
live-looking are then searched among the bare tokens of all texts, so a copy of a credential that
stands as a whole token of 16 or more characters with a digit, without its telltale context, is found
as well (kind ``copy``). A copy glued to other text by ``. = /`` is a longer token and is not.

Positions are code points, from lengths of the text between matches and of the matches. Counts
are pre-aggregated: a value that a third of the rows share is shuffled once per task.

Defined results: a NULL or empty text has no candidates; NULL repositories or owners count as one
unknown repository or owner. Repeated rows are scanned one by one. An empty table gives an empty
table. The needed columns are renamed first, so other columns cannot clash.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tableprobe.session import cut_lineage


class Pattern(NamedTuple):
    """Leftmost non-overlapping matches of ``regex``; ``group`` holds the value."""

    kind: str
    regex: str
    group: int
    min_chars: int  # of the value; shorter matches are dropped


# The three base patterns.
BASE = (
    Pattern(
        "assign",
        r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    Pattern("access", r"(AKIA[A-Z0-9]+)", 1, 18),
    Pattern("hex", r"([0-9a-f]+)", 1, 16),
)
# The same matches of the right length, found without the short ones.
QUICK = {"access": r"(AKIA[A-Z0-9]{14,})", "hex": r"([0-9a-f]{16,})"}
# A token of 16 or more characters with a digit, from its first character on.
BARE = Pattern("copy", r"(?<![A-Za-z0-9+/_.=-])(?=[A-Za-z+/_.=-]*[0-9])[A-Za-z0-9+/_.=-]{16,}", 0, 16)
MAX_LIVE_OWNERS = 1
MAX_LIVE_REPOSITORIES = 3
MIN_ENTROPY = 3.0  # bits per character of a live-looking value


def _parts(text: Column, rank: int, pattern: Pattern) -> Column:
    """Matches in order with the length of the text before each: (rank, i, gap, chars, value)."""
    regex = QUICK.get(pattern.kind, pattern.regex)
    whole = F.regexp_extract_all(text, F.lit(regex), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(regex), F.lit(pattern.group)) if pattern.group == 2 else whole
    gaps = F.slice(F.split(text, regex, -1), F.lit(1), F.size(whole))  # the text after the last match goes
    parts = F.transform(
        F.arrays_zip(gaps.alias("gap"), whole.alias("whole"), value.alias("value")),
        lambda m, i: F.struct(
            F.lit(rank).alias("rank"),
            i.alias("i"),
            F.length(m["gap"]).alias("gap"),
            F.length(m["whole"]).alias("chars"),
            m["value"].alias("value"),
        ),
    )
    empty = F.array().cast("array<struct<rank:int,i:int,gap:int,chars:int,value:string>>")
    return F.when(text.rlike(regex), parts).otherwise(empty)


def entropy(value: Column) -> Column:
    """Shannon entropy of the characters of a value in bits per character."""
    chars = F.filter(F.split(value, ""), lambda c: c != "")
    size = F.size(chars).cast("double")
    shares = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda x: x == c)).cast("double") / size)
    return F.aggregate(shares, F.lit(0.0), lambda total, share: total - share * F.log2(share))


def ownership(candidates: DataFrame) -> DataFrame:
    """Per hashed value: distinct repositories and owners, and whether it looks live.

    ``candidates`` has hash_, random_, repository_ and owner_. Each value is first reduced to its
    distinct (repository, owner), so that a widely copied one is small before it is counted.
    """
    once = candidates.groupBy("hash_", "repository_", "owner_").agg(F.max("random_").alias("random_"))
    by_owner = once.groupBy("hash_", "owner_").agg(F.max("random_").alias("random_"))
    by_repository = once.groupBy("hash_", "repository_").agg(F.lit(1).alias("one_"))
    counted = by_owner.groupBy("hash_").agg(F.count("*").alias("owners_"), F.max("random_").alias("random_")).join(
        by_repository.groupBy("hash_").agg(F.count("*").alias("repositories_")), "hash_"
    )
    live = (F.col("owners_") <= MAX_LIVE_OWNERS) & (F.col("repositories_") <= MAX_LIVE_REPOSITORIES) & F.col("random_")
    return counted.select("hash_", "owners_", "repositories_", live.alias("live_"))


def find(
    df: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    repository: str | None = "doc_id",
    owner: str | None = "source",
    patterns: tuple[Pattern, ...] = BASE,
) -> DataFrame:
    """Every row once: key_ and its findings in text order as ``spans_``.

    A finding is (start, rank, end, kind, owners, repositories, live); rank is the place of its
    kind in ``patterns``, copies of live-looking values come last. The corpus is scanned once;
    what is stored for the second look holds candidates only.
    """
    kinds = [*patterns, BARE]
    named = df.select(
        F.col(f"`{key}`").alias("key_"),
        (F.coalesce(F.col(f"`{repository}`").cast("string"), F.lit("")) if repository else F.lit("")).alias("repository_"),
        (F.coalesce(F.col(f"`{owner}`").cast("string"), F.lit("")) if owner else F.lit("")).alias("owner_"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text_"),
    )
    rows = cut_lineage(
        named.select(
            F.monotonically_increasing_id().alias("row_"),
            "key_",
            "repository_",
            "owner_",
            F.concat(*[_parts(F.col("text_"), rank, p) for rank, p in enumerate(kinds)]).alias("parts_"),
        )
    )
    so_far = W.partitionBy("row_", "rank").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    placed = (
        rows.select("row_", "repository_", "owner_", F.inline("parts_"))
        .withColumn("end", F.sum(F.col("gap") + F.col("chars")).over(so_far))
        .withColumn("start", F.col("end") - F.col("chars"))
        .where(
            F.length("value")
            >= F.element_at(F.array(*[F.lit(p.min_chars) for p in kinds]), F.col("rank") + 1)
        )
        .select(
            "row_",
            "repository_",
            "owner_",
            "rank",
            "start",
            "end",
            F.sha2("value", 256).alias("hash_"),
            (F.round(entropy(F.col("value")), 6) >= MIN_ENTROPY).alias("random_"),
        )
    )
    known = ownership(placed.where(F.col("rank") < len(patterns)))
    judged = placed.join(known, "hash_", "left").where(
        (F.col("rank") < len(patterns)) | F.coalesce(F.col("live_"), F.lit(False))
    )
    names = F.array(*[F.lit(p.kind) for p in kinds])
    finding = F.struct(
        "start",
        "rank",
        "end",
        F.element_at(names, F.col("rank") + 1).alias("kind"),
        F.col("owners_").alias("owners"),
        F.col("repositories_").alias("repositories"),
        F.col("live_").alias("live"),
    )
    per_row = judged.groupBy("row_").agg(F.array_sort(F.collect_list(finding)).alias("all_"))
    # A copy under a finding of a pattern is that finding.
    alone = F.filter(
        "all_",
        lambda f: (f["rank"] < len(patterns))
        | ~F.exists("all_", lambda g: (g["rank"] < len(patterns)) & (g["start"] < f["end"]) & (f["start"] < g["end"])),
    )
    kind = per_row.schema["all_"].dataType.simpleString()
    return rows.select("row_", "key_").join(per_row, "row_", "left").select(
        "key_", F.coalesce(alone, F.array().cast(kind)).alias("spans_")
    )
