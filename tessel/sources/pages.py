"""Raw web pages -> the flat cleaning table (doc_id, domain, url, title,
text_norm, text_len, chars, pos), JVM-side regex extraction only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.text import collapse_ws, url_domain
from tessel.sources.tables import read_table


def html_text(col) -> F.Column:
    """Visible text of an HTML page: drop script/style blocks and tags, collapse whitespace."""
    s = F.regexp_replace(col, r"(?is)<script[^>]*>.*?</script>", " ")
    s = F.regexp_replace(s, r"(?is)<style[^>]*>.*?</style>", " ")
    s = F.regexp_replace(s, r"<[^>]*>", " ")
    return collapse_ws(s)


def pages_flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "pages")
    t = html_text(F.col("html"))
    return p.select(
        F.col("page_id").alias("doc_id"), url_domain("url").alias("domain"), "url",
        F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"),
        t.alias("text_norm"), F.length(t).cast("bigint").alias("text_len"),
        F.length("html").cast("bigint").alias("chars"), F.col("page_id").alias("pos"))
