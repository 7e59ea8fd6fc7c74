"""How many texts go to Python at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows in a batch. Batches are counted in rows, but texts may be long.
MOST_ROWS = 1_000
_SETTING = "spark.sql.execution.arrow.maxRecordsPerBatch"


def in_small_batches(df: DataFrame) -> DataFrame:
    """``df``, whose session now sends at most ``MOST_ROWS`` rows at once to Python; a smaller setting stays."""
    conf = df.sparkSession.conf
    if not 0 < int(conf.get(_SETTING)) <= MOST_ROWS:
        conf.set(_SETTING, MOST_ROWS)
    return df
