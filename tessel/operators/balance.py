"""Train-set rebalancing: class weights, doc caps, oversampling, token caps,
alpha-quota resampling. All selection is by ``md5(seed:id)`` order within a
label using the bucketed rank, so a dominant label is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessel.functions.hashing import order_key
from tessel.functions.text import dup_suffix
from tessel.plans.rank import bucketed_rank

STRATEGIES = ("none", "cap_docs", "oversample", "cap_tokens", "alpha_total", "class_weights")


def label_counts(df: DataFrame, label_col: str = "label") -> DataFrame:
    return df.groupBy(label_col).agg(F.count(F.lit(1)).alias("n_docs"))


def class_weights(df: DataFrame, label_col: str = "label") -> DataFrame:
    """``w(label) = N / (n_labels * n_label)`` — sklearn's "balanced" weights."""
    c = label_counts(df, label_col)
    whole = Window.partitionBy()  # over the per-label table: one row per label
    return (c.withColumn("__N", F.sum("n_docs").over(whole))
            .withColumn("__L", F.count(F.lit(1)).over(whole))
            .select(label_col, "n_docs",
                    (F.col("__N") / (F.col("__L") * F.col("n_docs"))).alias("weight")))


def _ranked(df, seed, label_col, id_col, weight_col=None):
    d = df.withColumn("__h", order_key(id_col, seed))
    tie = "rid" if "rid" in df.columns else id_col  # ids may repeat, row keys do not
    return bucketed_rank(d, [label_col], "__h", tie, rank_col="__r", n_col="__n",
                         weight_col=weight_col, prefix_col="__pre" if weight_col else None)


def _extras(ranked: DataFrame, need: DataFrame, seed, label_col, id_col) -> DataFrame:
    """Duplicates drawn with replacement: ``need`` holds ``(label, n, need)``;
    draw k = 1..need picks the row of rank ``1 + H(seed:label:k) mod n`` and
    is emitted with id ``<id>#dup<k>``. Work is proportional to the extras."""
    draws = (need.where(F.col("__need") > 0)
             .select(label_col, "__n", F.explode(F.sequence(F.lit(1), F.col("__need"))).alias("__k"))
             .withColumn("__pick", F.lit(1) + F.pmod(
                 F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(label_col), F.col("__k").cast("string"))), 1, 15), 16, 10).cast("bigint"),
                 F.col("__n"))))
    d = draws.select(F.col(label_col).alias("__l"), "__k", "__pick")
    j = ranked.join(d, (ranked[label_col] == d["__l"]) & (ranked["__r"] == d["__pick"]))
    return j.withColumn(id_col, dup_suffix(id_col, "__k")).drop("__l", "__k", "__pick")


def cap_docs(df: DataFrame, cap: int, seed: int = 42, oversample: bool = False,
             label_col: str = "label", id_col: str = "id") -> DataFrame:
    """At most ``cap`` rows per label; with ``oversample`` labels below ``cap``
    are topped up to ``cap`` with duplicates (``#dup<k>`` ids)."""
    if int(cap or 0) <= 0:
        return df
    r = _ranked(df, seed, label_col, id_col)
    keep = r.where(F.col("__r") <= int(cap))
    out = keep.withColumn(id_col, F.col(id_col).cast("string"))
    if oversample:
        need = (r.where(F.col("__r") == 1).select(label_col, "__n")
                .withColumn("__need", F.greatest(F.lit(int(cap)) - F.col("__n"), F.lit(0))))
        ex = _extras(r.withColumn(id_col, F.col(id_col).cast("string")), need, seed, label_col, id_col)
        out = out.unionByName(ex)
    return out.drop("__h", "__r", "__n")


def oversample_to_max(df: DataFrame, seed: int = 42, label_col: str = "label", id_col: str = "id") -> DataFrame:
    """Every label topped up (with replacement) to the size of the largest label."""
    r = _ranked(df, seed, label_col, id_col)
    sizes = r.where(F.col("__r") == 1).select(label_col, "__n")
    need = sizes.withColumn("__need", F.max("__n").over(Window.partitionBy()) - F.col("__n"))
    rs = r.withColumn(id_col, F.col(id_col).cast("string"))
    return rs.unionByName(_extras(rs, need, seed, label_col, id_col)).drop("__h", "__r", "__n")


def cap_tokens(df: DataFrame, cap_tokens: int, seed: int = 42, tokens_col: str = "tokens",
               label_col: str = "label", id_col: str = "id") -> DataFrame:
    """Per label, in hash order, take rows while the running token total
    *before* the row is below ``cap_tokens`` (the crossing row is kept). If the
    whole label has ``T < cap`` tokens, a second pass over the same order
    duplicates row ``r`` (id ``#dup<r>``) iff ``T + prefix(r) < cap``."""
    cap = int(cap_tokens or 0)
    if cap <= 0:
        return df
    d = df.withColumn("__w", F.coalesce(F.col(tokens_col), F.lit(0)).cast("bigint"))
    r = _ranked(d, seed, label_col, id_col, weight_col="__w")
    totals = d.groupBy(label_col).agg(F.sum("__w").alias("__T"))
    r = r.join(totals, label_col)
    first = r.where(F.col("__pre") < cap).withColumn(id_col, F.col(id_col).cast("string"))
    dups = (r.where((F.col("__T") < cap) & (F.col("__T") + F.col("__pre") < cap))
            .withColumn(id_col, dup_suffix(id_col, "__r")))
    return first.unionByName(dups).drop("__h", "__r", "__n", "__w", "__pre", "__T")


def alpha_quotas(df: DataFrame, alpha: float, total: int, label_col: str = "label", may_drop: bool = False) -> DataFrame:
    """Quota per label: ``q = max(1, round_half_even(total * c^a / Σ c^a))``, then made to sum to ``total``:
    a shortage is dealt round-robin in label order; an excess is taken from the largest quotas,
    which are cut to a common level (what the level leaves over goes out one each, in label order), never below 1.
    When ``total`` is smaller than the number of labels it raises; with ``may_drop`` the common level is 0 instead, so the first ``total``
    labels in order get one each and the others none."""
    c = label_counts(df, label_col)
    whole = Window.partitionBy()
    q = (c.withColumn("__w", F.pow(F.col("n_docs").cast("double"), F.lit(float(alpha))))
         .withColumn("__p", F.col("__w") / F.sum("__w").over(whole))
         .withColumn("__q0", F.greatest(F.lit(1), F.bround(F.lit(float(total)) * F.col("__p"), 0).cast("bigint")))
         .withColumn("__i", F.row_number().over(whole.orderBy(label_col)) - 1)
         .withColumn("__L", F.count(F.lit(1)).over(whole))
         .withColumn("__d", F.lit(int(total)) - F.sum("__q0").over(whole)))
    # the largest level t with Σ min(q, t) <= total: the best over k of cutting the k largest
    large = whole.orderBy(F.desc("__q0"), label_col)
    q = (q.withColumn("__k", F.row_number().over(large))
         .withColumn("__rest", F.coalesce(F.sum("__q0").over(large.rowsBetween(1, Window.unboundedFollowing)), F.lit(0)))
         .withColumn("__t", F.max(F.floor((F.lit(int(total)) - F.col("__rest")) / F.col("__k"))).over(whole))
         .withColumn("__cut", F.least("__q0", "__t"))
         .withColumn("__left", F.lit(int(total)) - F.sum("__cut").over(whole))
         .withColumn("__j", F.sum(F.when(F.col("__q0") > F.col("__t"), 1).otherwise(0)).over(
             whole.orderBy(label_col).rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    more = F.floor(F.col("__d") / F.col("__L")) + F.when(F.col("__i") < F.pmod("__d", F.col("__L")), 1).otherwise(0)
    less = F.col("__cut") + F.when((F.col("__q0") > F.col("__t")) & (F.col("__j") <= F.col("__left")), 1).otherwise(0)
    quota = F.when(F.col("__d") >= 0, F.col("__q0") + more).otherwise(less)
    if not may_drop:
        quota = F.when(F.lit(int(total)) < F.col("__L"), F.raise_error(F.lit(f"alpha_total: total {int(total)} is less than the number of labels"))
                       .cast("bigint")).otherwise(quota)
    return q.select(label_col, "n_docs", quota.cast("bigint").alias("quota"))


def alpha_total(df: DataFrame, alpha: float, total: int, seed: int = 42,
                label_col: str = "label", id_col: str = "id") -> DataFrame:
    """Resample to ``total`` rows with alpha-smoothed label quotas: without
    replacement when ``quota <= n``, else all rows plus ``quota - n`` drawn
    with replacement."""
    q = alpha_quotas(df, alpha, total, label_col).select(F.col(label_col).alias("__lq"), "quota")
    r = _ranked(df, seed, label_col, id_col)
    # one row per label, but the label count is data-dependent: AQE measures it
    rq = r.join(q, r[label_col] == q["__lq"]).drop("__lq")
    keep = rq.where(F.col("__r") <= F.col("quota")).withColumn(id_col, F.col(id_col).cast("string"))
    need = (rq.where(F.col("__r") == 1).select(label_col, "__n", "quota")
            .withColumn("__need", F.greatest(F.col("quota") - F.col("__n"), F.lit(0))).drop("quota"))
    ex = _extras(rq.withColumn(id_col, F.col(id_col).cast("string")), need, seed, label_col, id_col)
    return keep.unionByName(ex).drop("__h", "__r", "__n", "quota")


def apply_balance(df: DataFrame, strategy: str = "none", seed: int = 42, label_col: str = "label",
                  id_col: str = "id", cap: int | None = None, cap_tokens_: int | None = None,
                  alpha: float = 1.0, total: int | None = None, tokens_col: str = "tokens") -> DataFrame:
    """Dispatch a balance strategy (applied to the *train* split only)."""
    s = (strategy or "none").strip().lower()
    if s == "none":
        return df
    if s == "class_weights":
        w = class_weights(df, label_col).select(F.col(label_col).alias("__lw"), "weight")
        return df.join(w, df[label_col] == w["__lw"], "left").drop("__lw")
    if s == "cap_docs":
        return cap_docs(df, cap, seed, False, label_col, id_col)
    if s == "cap_docs_oversample":
        return cap_docs(df, cap, seed, True, label_col, id_col)
    if s == "oversample":
        return oversample_to_max(df, seed, label_col, id_col)
    if s == "cap_tokens":
        return cap_tokens(df, cap_tokens_, seed, tokens_col, label_col, id_col)
    if s == "alpha_total":
        if total is None:
            raise ValueError("alpha_total needs total")
        return alpha_total(df, alpha, total, seed, label_col, id_col)
    raise ValueError(f"unknown balance strategy {strategy!r}")
