"""Main text of web pages.

Pages are independent rows: no shuffle, and a task holds one page at a time
besides its Arrow batch. The tree is trained on the driver from the labelled
table in ``html_blocks`` and goes along with the function.

Edge cases: a null or empty page, or one without an article block, has an
empty text. Broken and cut-off markup ends open parts with the page. Repeated
rows are each answered; extra columns are kept unless named as an added one,
which replaces them.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import small_batches
from .html_blocks import Tree, blocks, features, labelled_table, train


def main_text(page: str | None, tree: Tree) -> str:
    """The article blocks of one page, joined by a space."""
    found = blocks(page or "")
    kept = tree.tell(features(found))
    return " ".join(b.text for b, keep in zip(found, kept) if keep)


def extract_main_text(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The other columns with ``text`` and ``n_chars``, its code points."""
    tree = train(*labelled_table())

    def run(batches):
        for batch in batches:
            texts = [main_text(page, tree) for page in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])

    kept = [c for c in pages.columns if c not in (html_col, "text", "n_chars")]
    rows = small_batches(pages).select(F.struct(*kept).alias("row"), F.col(html_col).cast("string").alias("html"))
    schema = T.StructType([rows.schema["row"], T.StructField("text", T.StringType())])
    found = rows.mapInArrow(run, schema)
    return found.select("row.*", "text", F.length("text").cast("long").alias("n_chars"))
