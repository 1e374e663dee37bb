"""Broadcasting a side of a join only after its size has been checked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A checked side with at most this many (narrow) rows is broadcast.
SMALL_ROWS = 10_000


def checked(df: DataFrame, limit: int | None = None) -> DataFrame:
    """``df`` as a broadcast local table when it has at most ``limit`` rows, else ``df`` itself.

    Runs ``df`` once to find out, and never fetches more than ``limit + 1`` rows. Without this
    a small result of a large computation is joined by shuffling the large other side: its size
    is known only after both sides have been shuffled.
    """
    limit = SMALL_ROWS if limit is None else limit
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))
