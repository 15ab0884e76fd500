"""Small scalar rules used in reports and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Limits of the id-like test and of the highlighted shares in a summary.
ID_LIKE_RATIO = 0.5
ID_LIKE_DISTINCT = 30
HIGHLIGHT_MISSING = 0.10
HIGHLIGHT_DUPLICATES = 0.05


def features_to_rows(n_cols: Column, n_rows: Column) -> Column:
    return n_cols.cast("double") / F.greatest(n_rows.cast("double"), F.lit(1.0))


def similarity(distance: Column) -> Column:
    """Distance in [0, 2] as a similarity in [0, 1]."""
    # greatest and least skip NULLs, so an unknown distance is tested for.
    return F.when(distance.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - distance / 2)))


def estimated_distinct(ratio: Column, n_rows: Column) -> Column:
    return F.when(ratio.isNotNull(), F.greatest(F.lit(0), F.rint(ratio * n_rows).cast("long")))


def is_id_like(ratio: Column, n_rows: Column) -> Column:
    """A category column that names rows more than it groups them; unknown ratio: no."""
    many = (ratio > ID_LIKE_RATIO) | (estimated_distinct(ratio, n_rows) >= ID_LIKE_DISTINCT)
    return F.coalesce(F.when(n_rows > 0, many), F.lit(False))


def duration_seconds(started: Column, finished: Column) -> Column:
    """Whole seconds between two times, never negative; NULL while unfinished."""
    micros = F.unix_micros(finished.cast("timestamp")) - F.unix_micros(started.cast("timestamp"))
    return F.when(micros.isNotNull(), F.greatest(F.lit(0), F.floor(micros / 1e6 + 0.5).cast("long")))


def duration_text(seconds: Column) -> Column:
    """``45 s``, ``3 min`` or ``3 min 5 s``."""
    minutes = F.floor(seconds / 60).cast("string")
    rest = seconds % 60
    return (
        F.when(seconds.isNull(), F.lit(None).cast("string"))
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit(" s")))
        .when(rest == 0, F.concat(minutes, F.lit(" min")))
        .otherwise(F.concat(minutes, F.lit(" min "), rest.cast("string"), F.lit(" s")))
    )


def shorten(text: Column, limit: int) -> Column:
    """Text cut to ``limit`` characters with an ellipsis when something was cut."""
    return F.when(
        F.length(text) > limit, F.concat(F.rtrim(F.substring(text, 1, limit)), F.lit("…"))
    ).otherwise(text)


def highlight_missing(share: Column) -> Column:
    return share > HIGHLIGHT_MISSING


def highlight_duplicates(share: Column) -> Column:
    return share > HIGHLIGHT_DUPLICATES
