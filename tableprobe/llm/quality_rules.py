"""Quality rules: a table of thresholds compiled into one Spark projection.

A rule is a row ``(name, measure, low, high)``. Measures are column expressions over one text;
the table is compiled into boolean columns and one verdict. Everything is built-in functions in
one stage: no user function, no shuffle, so a text of any length costs about its length.

Defined results: a NULL text has no words (all counts 0) and fails the word-count rule; an empty
text likewise. Repeated rows and repeated ids are judged one by one, an empty table gives an
empty table. Only the id and text columns are read, so other columns cannot clash.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"
SYMBOLS = "#*$%&|<>"


class Rule(NamedTuple):
    """A text fails when ``measure`` is below ``low`` or above ``high`` (None: no bound)."""

    name: str
    measure: str
    low: float | None
    high: float | None


# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the of and to in is that with for it was on are as be by this "
    "der die das und ist ein eine den von zu mit nicht auf "
    "le la les de des et est un une du en que dans pour "
    "el los las y es una con por para del se"
).split()

DEFAULT_RULES = (
    Rule("words", "n_words", 50, 100_000),
    Rule("word_length", "mean_word_chars", 3.0, 10.0),
    Rule("symbols", "symbol_ratio", None, 0.1),
    Rule("stop_words", "n_stop_words", 2, None),
    Rule("duplicate_lines", "dup_line_ratio", None, 0.3),
    Rule("bullet_lines", "bullet_line_ratio", None, 0.9),
    Rule("ellipsis_lines", "ellipsis_line_ratio", None, 0.3),
)


def _ratio(part: Column, whole: Column) -> Column:
    """part / whole as double, 0.0 for an empty whole."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(part.cast("double") / whole.cast("double"))


INDEX_BITS = 20


def _in_hash_order(hashes: Column) -> Column:
    """Window numbers in the order of their hashes, as a sort of plain longs.

    A number takes the low 20 bits of its hash, so sorting needs no structs. Texts with more
    windows than that are sorted as structs. A text without a repeated hash gives none.
    """
    low = F.lit((1 << INDEX_BITS) - 1).cast("long")
    packed = F.transform(hashes, lambda h, i: h.bitwiseAND(F.bitwise_not(low)).bitwiseOR(i.cast("long")))
    short = F.transform(F.sort_array(packed), lambda x: x.bitwiseAND(low).cast("int"))
    pairs = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    long = F.transform(F.array_sort(pairs), lambda x: x["i"])
    return (
        F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.array().cast("array<int>"))
        .when(F.size(hashes) < (1 << INDEX_BITS), short)
        .otherwise(long)
    )


def measures(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``df``: the id as ``key_``, counts and ratios of its text."""
    base = df.select(F.col(f"`{key}`").alias("key_"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("t_"))
    words = base.select(
        "key_",
        "t_",
        F.array_remove(F.split("t_", SPACES), "").alias("w_"),
        F.filter(F.split("t_", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")).alias("l_"),
    )
    w, lines = F.col("w_"), F.col("l_")
    counted = words.select(
        "key_",
        F.size(w).cast("long").alias("n_words"),
        F.length(F.translate("t_", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length("t_") - F.length(F.translate("t_", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.size(lines).cast("long").alias("n_lines"),
        (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        F.size(F.array_except(F.array(*[F.lit(s) for s in STOP_WORDS]), w)).alias("absent_"),
        F.size(F.filter(lines, lambda x: x.rlike(r"^[\x20\x09-\x0D]*[-*•]"))).cast("long").alias("n_bullet_lines"),
        F.size(F.filter(lines, lambda x: x.rlike(r"(\.\.\.|…)[\x20\x09-\x0D]*$"))).cast("long").alias("n_ellipsis_lines"),
        F.when(F.size(w) < 3, F.array().cast("array<bigint>"))
        .otherwise(
            F.transform(
                F.slice(w, 1, F.greatest(F.size(w) - 2, F.lit(0))),
                lambda x, i: F.xxhash64(x, w[i + 1], w[i + 2]),
            )
        )
        .alias("h_"),
    )
    placed = counted.withColumn("p_", _in_hash_order(F.col("h_")))
    p, h = F.col("p_"), F.col("h_")

    # Windows next to one of the same hash, back in text order: each adds the words that the
    # window before it has not covered.
    def same(i: Column, j: Column) -> Column:
        return F.coalesce(F.get(h, i) == F.get(h, F.get(p, j)), F.lit(False))

    twice = F.filter(p, lambda i, at: same(i, at - 1) | same(i, at + 1))
    starts = placed.withColumn("s_", F.sort_array(twice))
    s = F.col("s_")
    covered = F.aggregate(
        F.transform(s, lambda x, i: F.least(F.lit(3), x - F.coalesce(F.get(s, i - 1), F.lit(-3)))),
        F.lit(0).cast("long"),
        lambda total, new: total + new,
    )
    return starts.select(
        "key_",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        covered.alias("n_repeat_words"),
        (F.lit(len(STOP_WORDS)) - F.col("absent_")).cast("long").alias("n_stop_words"),
        _ratio(F.col("word_chars"), F.col("n_words")).alias("mean_word_chars"),
        _ratio(F.col("n_symbols"), F.col("n_words")).alias("symbol_ratio"),
        _ratio(F.col("n_dup_lines"), F.col("n_lines")).alias("dup_line_ratio"),
        _ratio(F.col("n_bullet_lines"), F.col("n_lines")).alias("bullet_line_ratio"),
        _ratio(F.col("n_ellipsis_lines"), F.col("n_lines")).alias("ellipsis_line_ratio"),
    )


def compile_rules(rules: tuple[Rule, ...]) -> list[Column]:
    """One boolean column ``fails_<name>`` per row of the table."""

    def fails(rule: Rule) -> Column:
        value, out = F.col(rule.measure), F.lit(False)
        if rule.low is not None:
            out = out | (value < F.lit(rule.low))
        if rule.high is not None:
            out = out | (value > F.lit(rule.high))
        return out.alias(f"fails_{rule.name}")

    return [fails(rule) for rule in rules]


def apply_rules(df: DataFrame, rules: tuple[Rule, ...] = DEFAULT_RULES, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Measures, one ``fails_<rule>`` column per rule and ``passed``; the id is in ``key_``.

    ``failed`` lists the names of the failed rules in the order of the table.
    """
    flags = measures(df, key, text).select("*", *compile_rules(rules))
    names = F.array(*[F.when(F.col(f"fails_{r.name}"), F.lit(r.name)) for r in rules])
    failed = F.array_compact(names) if rules else F.array().cast("array<string>")
    return flags.select("*", failed.alias("failed")).withColumn("passed", F.size("failed") == 0)
