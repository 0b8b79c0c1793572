"""Exact deduplication and the cleaning report.

Survivor choice is always by an explicit order key (Spark rows have no file
order). Each step aggregates ``key -> winning row`` with a partial ``min`` (a key
holding a third of the corpus is combined map-side, never sent whole to one task).
A winner is a row, not an id: tables with a unique row key (``row_id``) keep the
winners with a left-semi join on it, so that texts stay out of the shuffle;
for tables without one the winning row itself is the aggregate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessel.functions.text import collapse_ws, dedup_text_key, norm_title, py_strip
from tessel.session import materialize

DEDUP_MODES = ("none", "id", "text", "id_and_text")


def dedup_key(mode: str, id_col: str = "id", text_col: str = "text"):
    """Digest of the dedup key; a missing (null or empty) id falls back to the text in mode ``id``
    and counts as empty in mode ``id_and_text``."""
    mode = (mode or "none").strip().lower()
    ident = F.col(id_col).cast("string")
    if mode == "id":
        return F.md5(F.coalesce(F.when(ident != "", ident), F.col(text_col)))
    if mode == "text":
        return dedup_text_key(text_col)
    if mode == "id_and_text":
        return F.md5(F.concat(py_strip(F.coalesce(ident, F.lit(""))), F.lit("||"), F.lower(collapse_ws(text_col))))
    raise ValueError(f"unknown dedup mode {mode!r}")


def keep_first(df: DataFrame, key, order_col: str, id_col: str = "id", row_id: str | None = None) -> DataFrame:
    """Keep, per key, the one row that is smallest by ``order_col`` then ``id_col`` (then
    the row key, or the text's digest)."""
    if row_id:
        order = F.struct(F.col(order_col).alias("o"), F.col(id_col).alias("i"), F.col(row_id).alias("r"))
        winners = df.select(key.alias("__k"), order.alias("__s")).groupBy("__k").agg(F.min("__s").alias("__w")).select(F.col("__w.r").alias("__r"))
        return df.join(winners, df[row_id] == winners["__r"], "left_semi")
    last = [F.md5("text")] if "text" in df.columns else []
    order = F.struct(F.col(order_col).alias("o"), F.col(id_col).alias("i"), *[c.alias(f"t{n}") for n, c in enumerate(last)])
    rows = df.select(key.alias("__k"), order.alias("__s"), F.struct(*df.columns).alias("__row"))
    return rows.groupBy("__k").agg(F.min_by("__row", "__s").alias("__w")).select("__w.*")


def dedup(df: DataFrame, on: str = "text", order_col: str = "id", id_col: str = "id",
          text_col: str = "text", row_id: str | None = None) -> DataFrame:
    """Exact dedup on ``id`` / normalised ``text`` / ``id_and_text``; keep the first by ``order_col``."""
    on = (on or "none").strip().lower()
    if on in ("none", "", "no"):
        return df
    return keep_first(df, dedup_key(on, id_col, text_col), order_col, id_col, row_id)


def title_domain_winners(df: DataFrame, domain_col: str = "domain", title_col: str = "title",
                         len_col: str = "text_len", chars_col: str = "chars", pos_col: str = "pos",
                         id_col: str = "doc_id") -> DataFrame:
    """Per ``(domain, normalised title)`` the surviving id: longest text, then most
    chars, then earliest position. Empty titles never collide."""
    nt = norm_title(title_col)
    order = F.struct((-F.col(len_col)).alias("a"), (-F.coalesce(F.col(chars_col), F.lit(0))).alias("b"),
                     F.col(pos_col).alias("c"), F.col(id_col).alias("i"))
    return (df.where(nt != "")
            .select(F.col(domain_col).alias("__d"), nt.alias("__nt"), order.alias("__s"))
            .groupBy("__d", "__nt").agg(F.min("__s").alias("__w"))
            .select(F.col("__w.i").alias("__win")))


def dedup_title_domain(df: DataFrame, **kw) -> DataFrame:
    """Drop all but one document per ``(domain, normalised title)``."""
    id_col = kw.get("id_col", "doc_id")
    title_col = kw.get("title_col", "title")
    win = title_domain_winners(df, **kw)
    losers_free = df.join(win, df[id_col] == win["__win"], "left")
    keep = (norm_title(title_col) == "") | F.col("__win").isNotNull()
    return losers_free.where(keep).drop("__win")


def cleaning_report(df: DataFrame, min_len: int = 400, id_col: str = "doc_id",
                    text_len_col: str = "text_len", near_dup_losers: DataFrame | None = None,
                    **kw) -> DataFrame:
    """Per-document report ``kept`` / ``drop_reason`` of the cleaning passes.

    Steps run in order on the rows still kept: ``short`` (text shorter than
    ``min_len``), ``dup_title_domain`` (not the survivor of its
    domain+title group), then optionally ``lsh_dup`` (ids in
    ``near_dup_losers``). Reasons accumulate joined by ``+`` without repeats.
    """
    short = F.col(text_len_col) < int(min_len)
    base = df.withColumn("__short", short)
    live = base.where(~F.col("__short"))
    win = title_domain_winners(live, id_col=id_col, len_col=text_len_col, **kw)
    title_col = kw.get("title_col", "title")
    dup_ids = (live.where(norm_title(title_col) != "")
               .join(win, live[id_col] == win["__win"], "left_anti")
               .select(F.col(id_col).alias("__dup")))
    out = base.join(dup_ids, base[id_col] == dup_ids["__dup"], "left")
    reasons = [F.when(F.col("__short"), F.lit("short")),
               F.when(F.col("__dup").isNotNull(), F.lit("dup_title_domain"))]
    if near_dup_losers is not None:
        nd = near_dup_losers.select(F.col(near_dup_losers.columns[0]).alias("__nd"))
        out = out.join(nd, out[id_col] == nd["__nd"], "left")
        reasons.append(F.when(F.col("__nd").isNotNull() & ~F.col("__short") & F.col("__dup").isNull(),
                              F.lit("lsh_dup")))
    reason = F.array_join(F.array_distinct(F.filter(F.array(*reasons), lambda x: x.isNotNull())), "+")
    out = out.withColumn("drop_reason", reason).withColumn("kept", F.col("drop_reason") == "")
    return out.drop("__short", "__dup", "__nd")


def near_dup_losers(live: DataFrame, min_docs: int = 500, min_len: int = 800, threshold: float = 0.9, bands: int = 16, rows: int = 4,
                    id_col: str = "doc_id", domain_col: str = "domain", text_col: str = "text_norm") -> DataFrame:
    """Ids of near-duplicates to drop within each domain of at least ``min_docs`` documents, among texts of ``min_len``
    characters or more: of each greedy cluster all but the longest text (then most chars, then first position)."""
    from tessel.operators.greedy import greedy_clusters
    found = greedy_clusters(live, min_docs, min_len, threshold, bands, rows, id_col, domain_col, text_col)
    return found.where("NOT kept").select("id")


def write_id_lists(report: DataFrame, path: str, id_col: str = "doc_id") -> tuple[str, str]:
    """Sorted keep and drop lists, one id per line, in ``<path>/keep`` and ``<path>/drop``."""
    out = []
    for name, cond in (("keep", F.col("kept")), ("drop", ~F.col("kept"))):
        (report.where(cond).select(F.col(id_col).cast("string").alias("value")).orderBy("value")
         .write.mode("overwrite").text(f"{path}/{name}"))
        out.append(f"{path}/{name}")
    return out[0], out[1]


def multiplicity(df: DataFrame, key_col: str) -> DataFrame:
    """Key multiplicity summary: distinct keys, keys with >= 2 rows, excess rows Σ(c-1)."""
    per = df.where(F.col(key_col).isNotNull()).groupBy(key_col).agg(F.count(F.lit(1)).alias("c"))
    return per.agg(F.count(F.lit(1)).alias("n_unique"),
                   F.sum(F.when(F.col("c") >= 2, 1).otherwise(0)).cast("bigint").alias("n_multi"),
                   F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).cast("bigint").alias("excess_docs"))


def exact_duplicates(df: DataFrame, key_col: str, by: str | None = None) -> DataFrame:
    """Rows whose key occurs more than once (``duplicated(keep=False)``), counted
    per ``by`` value. Counts per ``(key, by)`` are pre-aggregated, so only the
    small per-key table is re-grouped — no per-row window over a hot key."""
    by_cols = [by] if by else []
    per = df.groupBy(key_col, *by_cols).agg(F.count(F.lit(1)).alias("c"))
    tot = per.groupBy(key_col).agg(F.sum("c").alias("t"))
    j = per.join(tot, key_col)
    return (j.groupBy(*by_cols).agg(
        F.sum("c").cast("bigint").alias("n_docs"),
        F.sum(F.when(F.col("t") > 1, F.col("c")).otherwise(0)).cast("bigint").alias("n_dup_docs"))
        .withColumn("dup_share", F.round(F.col("n_dup_docs") / F.col("n_docs"), 6)))
