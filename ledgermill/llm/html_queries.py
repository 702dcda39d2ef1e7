"""Main texts of ``pages``."""

from __future__ import annotations

from .html_text import extract_main_text
from .registry import query, table


@query("op3_html_extraction")
def op3_html_extraction(spark, folder):
    """The article of every page."""
    return extract_main_text(table(spark, folder, "pages")).select("page_id", "url", "text", "n_chars")
