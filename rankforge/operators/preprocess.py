"""The configured cleaning steps, in their fixed order, as one projection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankforge.config import Config
from rankforge.functions import text as T
from rankforge.functions.pages import remove_page_edges


def preprocess(documents: DataFrame, config: Config) -> DataFrame:
    """documents with cleaned text and the names of the steps in `preprocessing_steps`."""
    p = config["preprocessing"]
    t, steps = F.col("text"), []
    if p["normalize_unicode"]:
        t, steps = T.normalize_unicode(t), [*steps, "normalize_unicode"]
    if p["remove_headers"] or p["remove_footers"]:
        t = remove_page_edges(t, p["remove_headers"], p["remove_footers"], p["header_footer_removal_threshold"])
        steps = [*steps, "remove_headers_footers"]
    if p["remove_page_numbers"]:
        t, steps = T.remove_page_numbers(t), [*steps, "remove_page_numbers"]
    if p["cleanup_whitespace"]:
        t, steps = T.cleanup_whitespace(t), [*steps, "cleanup_whitespace"]
    if p["remove_empty_lines"]:
        t, steps = T.remove_empty_lines(t), [*steps, "remove_empty_lines"]
    return documents.withColumns({"text": t, "preprocessing_steps": F.array(*[F.lit(s) for s in steps]).cast("array<string>")})
