"""How much of a table travels to a Python task at once."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: Rows and bytes of an Arrow batch; a longer row is a batch of its own.
BATCH_ROWS = 1000
BATCH_BYTES = 8 << 20


def small_batches(frame: DataFrame) -> DataFrame:
    """The frame, after bounding the session's Arrow batches.

    Whole texts and sets of shingles are large rows: batches of thousands of
    them would be held several times over, by the executor and by its Python
    workers. A smaller bound that the session has already stays.
    """
    conf = frame.sparkSession.conf
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{key}"
        digits = "".join(c for c in conf.get(name) if c.isdigit()) or "0"
        if not 0 < int(digits) <= most:
            conf.set(name, str(most))
    return frame
