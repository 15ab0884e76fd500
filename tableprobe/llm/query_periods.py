"""Query of the periodic runs; tests compare it with all periods tried one by one."""

from __future__ import annotations

import zlib

from pyspark.sql import functions as F

from tableprobe.llm.periods import periodic_runs
from tableprobe.llm.registry import register, table


def repeated(key: int | None, words: list[bytes]) -> list[bytes]:
    """The rule of the query: the words of every tenth row go on periodically from some word on."""
    h = zlib.crc32(str(key).encode()) if key is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


@register("op12_periodic_runs")
def op12_periodic_runs(spark, folder):
    """Every document's runs of 12 words and more, the longest one, and the text without repetition."""
    found = periodic_runs(table(spark, folder, "documents"), rewrite=repeated, hashed=True)
    runs = F.col("runs_")
    order = F.transform(runs, lambda r: F.struct(-r["length"], r["start"], r["period"], r["length"]))
    best = F.array_min(order)
    lines = F.transform(runs, lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    whole = F.when(F.size(runs) > 0, F.concat(F.array_join(lines, "\n"), F.lit("\n"))).otherwise("")
    fields = found.withColumn("best", best).select(
        F.col("key_").alias("doc_id"),
        F.size(runs).cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        F.col("best.length").alias("length"),
        F.col("best.period").alias("period"),
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(whole, 256).alias("runs_sha256"),
        F.col("collapsed_").alias("collapsed_sha256"),
    )
    return fields
