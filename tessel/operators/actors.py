"""Actor operators: inventory from documents, merge with an existing actor
table, majority vote of raw ideology labels, derived label maps, and the
domain-then-crawl actor resolution of the prepare stage."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessel.functions.text import norm_key, norm_key_ws, norm_label, py_strip

# Raw label spellings per ideology class (after key normalisation).
LEFT_RAW = ["gauche", "gauche_moderee", "gauche_moderée", "left", "centre_gauche", "centre-left"]
FAR_LEFT_RAW = ["exgauche", "extreme_gauche", "extrême_gauche", "far_left"]
RIGHT_RAW = ["droite", "droite_moderee", "droite_moderée", "right", "centre_droite", "centre-right"]
FAR_RIGHT_RAW = ["exdroite", "extreme_droite", "extrême_droite", "far_right"]
CENTER_RAW = ["centre", "center"]

ACTOR_SCHEMA = ("pos long, actor_id string, crawls array<string>, domains array<string>, "
                "side_binary string, global_five string, intra_left string, intra_right string")


def actors_frame(spark: SparkSession, rows: Sequence[tuple]) -> DataFrame:
    """Actor table from driver-side rows ``(actor_id, crawls, domains, side, five, intra_l, intra_r)``;
    ``pos`` keeps the file order (later actors win duplicate keys)."""
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], ACTOR_SCHEMA)


def classify_raw_label(raw) -> Column:
    """Raw label -> struct(side_binary, global_five, intra_left, intra_right)."""
    k = norm_key_ws(raw)

    def s(a, b, c, d):
        return F.struct(F.lit(a).cast("string").alias("side_binary"), F.lit(b).cast("string").alias("global_five"),
                        F.lit(c).cast("string").alias("intra_left"), F.lit(d).cast("string").alias("intra_right"))
    return (F.when(k.isin(FAR_LEFT_RAW), s("left", "far_left", "exgauche", None))
            .when(k.isin(LEFT_RAW), s("left", "left", "gauche", None))
            .when(k.isin(FAR_RIGHT_RAW), s("right", "far_right", None, "exdroite"))
            .when(k.isin(RIGHT_RAW), s("right", "right", None, "droite"))
            .when(k.isin(CENTER_RAW), s(None, "center", None, None))
            .otherwise(s(None, None, None, None)))


def actor_inventory(docs: DataFrame, domain_col: str = "domain", crawl_col: str = "crawl",
                    id_col: str = "id", top_variants: int = 5, fallbacks: Sequence[str] = ("folder", "folder_path")) -> DataFrame:
    """Per actor key (``norm_key`` of domain, else crawl, else folder, else folder path, else id): document
    count, sorted ``;``-joined crawl and domain keys, and the top raw variants
    as ``raw×count`` (count desc, raw asc). Rows are first counted per raw strings; keys are
    normalised, sets and the top-k taken on that table.
    """
    given = lambda c: F.when(py_strip(F.col(c)) != "", py_strip(F.col(c)))
    chain = [domain_col, crawl_col, *[c for c in fallbacks if c in docs.columns]]
    raw = F.coalesce(*[given(c) for c in chain], F.col(id_col).cast("string"))
    d = docs.select(raw.alias("raw"), given(domain_col).alias("d"), given(crawl_col).alias("c0"))
    d = d.groupBy("raw", "d", "c0").agg(F.count(F.lit(1)).alias("c"))
    d = d.select("raw", F.when(F.col("d").isNotNull(), norm_key("d")).alias("dk"), F.when(F.col("c0").isNotNull(), norm_key("c0")).alias("ck"),
                 norm_key("raw").alias("key"), "c").where(F.col("key") != "")
    per = d.groupBy("key", "raw", "dk", "ck").agg(F.sum("c").alias("c"))
    var = per.groupBy("key", "raw").agg(F.sum("c").alias("c"))
    w = Window.partitionBy("key").orderBy(F.desc("c"), F.asc("raw"))
    top = (var.withColumn("r", F.row_number().over(w)).where(F.col("r") <= int(top_variants))
           .groupBy("key").agg(F.array_join(F.transform(
               F.array_sort(F.collect_list(F.struct("r", F.concat(F.col("raw"), F.lit("×"), F.col("c").cast("string")).alias("s")))),
               lambda x: x["s"]), "; ").alias("variant_examples")))
    agg = per.groupBy("key").agg(
        F.sum("c").alias("doc_count"),
        F.array_join(F.array_sort(F.collect_set("ck")), ";").alias("crawl_ids"),
        F.array_join(F.array_sort(F.collect_set("dk")), ";").alias("domain_ids"))
    return agg.join(top, "key").select(F.col("key").alias("actor_id"), "crawl_ids", "domain_ids",
                                       "doc_count", "variant_examples")


def merge_actors(found: DataFrame, existing: DataFrame) -> DataFrame:
    """Full outer merge of found actors (``actor_id, crawls, domains, doc_count``)
    into an existing actor table: found actors get the set-union of crawls and
    domains (sorted) and keep the manual label columns; actors only in the
    existing table are kept as-is and marked ``stale``."""
    f = found.select(F.col("actor_id").alias("fid"), F.col("crawls").alias("fc"),
                     F.col("domains").alias("fd"), "doc_count")
    e = existing.select(F.col("actor_id").alias("eid"), F.col("crawls").alias("ec"), F.col("domains").alias("ed"),
                        "side_binary", "global_five", "intra_left", "intra_right")
    j = f.join(e, f["fid"] == e["eid"], "full")
    in_found = F.col("fid").isNotNull()
    empty = F.array().cast("array<string>")

    def union(a, b):
        return F.array_sort(F.array_distinct(F.concat(F.coalesce(F.col(a), empty), F.coalesce(F.col(b), empty))))
    return j.select(
        F.coalesce("fid", "eid").alias("actor_id"),
        F.when(in_found, union("ec", "fc")).otherwise(F.col("ec")).alias("crawls"),
        F.when(in_found, union("ed", "fd")).otherwise(F.col("ed")).alias("domains"),
        "side_binary", "global_five", "intra_left", "intra_right",
        F.when(in_found, F.col("doc_count")).alias("doc_count"),
        (~in_found).alias("stale"),
        (in_found & F.col("eid").isNull()).alias("is_new"))


def label_vote(actor_crawls: DataFrame, raw_labels: DataFrame) -> DataFrame:
    """Majority vote of raw labels per actor.

    ``actor_crawls(actor_id, crawl)`` ⨝ ``raw_labels(crawl, raw_label)`` on the
    normalised crawl key; each raw label is classified; if an actor's labels
    name both sides every output is null, else each dimension takes its most
    frequent value (ties -> the value seen first, in crawl order)."""
    lab = raw_labels.where(F.col("raw_label").isNotNull() & (F.trim("raw_label") != "")).select(
        norm_key_ws("crawl").alias("ck"), F.trim("raw_label").alias("raw_label"))
    ac = actor_crawls.select("actor_id", "crawl", norm_key_ws("crawl").alias("ck"))
    j = ac.join(lab, "ck").withColumn("cls", classify_raw_label(F.col("raw_label")))
    dims = ["side_binary", "global_five", "intra_left", "intra_right"]
    long = j.select("actor_id", "crawl", F.explode(F.array(*[
        F.struct(F.lit(d).alias("dim"), F.col("cls")[d].alias("val")) for d in dims])).alias("x")
    ).select("actor_id", "crawl", "x.dim", "x.val").where(F.col("val").isNotNull())
    cnt = long.groupBy("actor_id", "dim", "val").agg(F.count(F.lit(1)).alias("c"), F.min("crawl").alias("first"))
    w = Window.partitionBy("actor_id", "dim").orderBy(F.desc("c"), F.asc("first"))
    best = cnt.withColumn("r", F.row_number().over(w)).where("r = 1")
    sides = cnt.where(F.col("dim") == "side_binary").groupBy("actor_id").agg(F.count(F.lit(1)).alias("n_sides"))
    piv = best.groupBy("actor_id").agg(*[F.max(F.when(F.col("dim") == d, F.col("val"))).alias(d) for d in dims])
    actors = actor_crawls.select("actor_id").distinct()
    out = actors.join(piv, "actor_id", "left").join(sides, "actor_id", "left")
    conflict = F.coalesce(F.col("n_sides"), F.lit(0)) > 1
    return out.select("actor_id", *[F.when(~conflict, F.col(d)).alias(d) for d in dims])


def derive_label_maps(actors: DataFrame) -> DataFrame:
    """Key -> label maps of the three derived views (``global`` from
    ``global_five``, ``left_intra``, ``right_intra``): every crawl and domain of
    an actor maps to the actor's label; on a duplicate key the later actor wins."""
    keys = actors.select("pos", "actor_id", "global_five", "intra_left", "intra_right",
                         F.explode(F.concat(F.coalesce("crawls", F.array().cast("array<string>")),
                                            F.coalesce("domains", F.array().cast("array<string>")))).alias("key"))
    views = keys.select("pos", "key", F.explode(F.array(
        F.struct(F.lit("global").alias("view"), F.col("global_five").alias("label")),
        F.struct(F.lit("left_intra").alias("view"), F.col("intra_left").alias("label")),
        F.struct(F.lit("right_intra").alias("view"), F.col("intra_right").alias("label")))).alias("m"))
    return (views.select("pos", "key", "m.view", "m.label").where(F.col("label").isNotNull() & (F.col("label") != ""))
            .groupBy("view", "key").agg(F.max_by("label", "pos").alias("label")))


VIEWS = ("binary", "five_way", "left_intra", "right_intra")


def resolve_actors(docs: DataFrame, actors: DataFrame, view: str = "binary",
                   unknown_policy: str = "drop", unknown_label: str = "unknown_actor",
                   domain_col: str = "domain", crawl_col: str = "crawl", small: bool = False) -> DataFrame:
    """Resolve each row's actor (domain key first, then crawl key; later actors
    win duplicate keys) and its label for ``view``; adds ``actor``, ``label``
    and ``reason`` (``ok`` / ``unknown_actor_kept`` / ``unknown_actor_dropped`` /
    ``actor_not_left`` / ``actor_not_right`` / ``label_missing_for_view`` /
    ``unknown_view_<v>``). The key maps are dimension tables: Spark broadcasts them when their
    size allows; ``small`` forces it for tables whose bound the caller knows."""
    def keymap(col, alias):
        m = (actors.select("pos", "actor_id", F.explode(col).alias("k"))
             .select("pos", "actor_id", norm_label("k").alias("k")).where(F.col("k") != "")
             .groupBy("k").agg(F.max_by("actor_id", "pos").alias(alias)))
        return F.broadcast(m) if small else m
    dm = keymap("domains", "__da").withColumnRenamed("k", "__dk")
    cm = keymap("crawls", "__ca").withColumnRenamed("k", "__ck")
    info = actors.select(F.col("actor_id").alias("__aid"), "side_binary", "global_five", "intra_left", "intra_right")
    if small:
        info = F.broadcast(info)
    d = (docs.withColumn("__dn", norm_label(F.coalesce(F.col(domain_col), F.lit(""))))
         .withColumn("__cn", norm_label(F.coalesce(F.col(crawl_col), F.lit("")))))
    d = d.join(dm, d["__dn"] == dm["__dk"], "left").join(cm, d["__cn"] == cm["__ck"], "left")
    d = d.withColumn("actor", F.coalesce(F.when(F.col("__dn") != "", F.col("__da")), F.col("__ca")))
    d = d.join(info, d["actor"] == info["__aid"], "left")
    known = F.col("actor").isNotNull()
    keep_unknown = (unknown_policy or "drop").strip().lower() == "keep"
    none = F.lit(None).cast("string")
    if view == "binary":
        lab, gate = F.col("side_binary"), None
    elif view == "five_way":
        lab, gate = F.col("global_five"), None
    elif view == "left_intra":
        lab, gate = F.col("intra_left"), (F.coalesce(F.col("side_binary"), F.lit("")) != "left", "actor_not_left")
    elif view == "right_intra":
        lab, gate = F.col("intra_right"), (F.coalesce(F.col("side_binary"), F.lit("")) != "right", "actor_not_right")
    else:
        lab, gate = none, (F.lit(True), f"unknown_view_{view}")
    has = lab.isNotNull() & (lab != "")
    reason = F.when(~known, F.lit("unknown_actor_kept" if keep_unknown else "unknown_actor_dropped"))
    label = F.when(~known, F.lit(unknown_label) if keep_unknown else none)
    if gate is not None:
        reason = reason.when(gate[0], F.lit(gate[1]))
        label = label.when(gate[0], none)
    reason = reason.when(~has, F.lit("label_missing_for_view")).otherwise(F.lit("ok"))
    label = label.when(~has, none).otherwise(lab)
    out = d.withColumn("label", label).withColumn("reason", reason)
    return out.drop("__dn", "__cn", "__dk", "__da", "__ck", "__ca", "__aid", "side_binary", "global_five",
                    "intra_left", "intra_right")
