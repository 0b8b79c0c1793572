"""The prepare stage as one plan over a key table.

Order is the reference's and matters: length filter -> token count -> token
filter -> modality counts/filter -> label mapping -> unlabelled drop -> dedup
-> global cap -> actor filters -> stratified split -> balance (train only).

Everything after the scan runs on narrow keys: one pass over the text projects length,
tokens and the dedup digest next to the row's small columns; labels, dedup, caps,
split and balance work on that table, written once. Texts are read a second time,
at the end, and cross one exchange, where they meet the decisions by row key.
Rows are identified by ``rid``, never by ``id``: ids may repeat or be missing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.functions.text import token_count
from tessel.operators import actors as act
from tessel.operators import balance, dedup, filters, labels, split
from tessel.session import scratch_path
from tessel.sources.tables import attach_labels, document_rows


@dataclass
class PrepareParams:
    label_view: str = "quality"
    min_chars: int | None = 200
    tokenizer: str = "split"
    max_tokens: int | None = None
    modality: str | None = None
    label_map: Mapping[str, str] | None = None
    unknown_policy: str = "drop"
    other_label: str = "other"
    dedup_on: str = "text"
    max_docs: int | None = None
    actor_include: list = field(default_factory=list)
    actor_min_docs: int = 0
    actor_col: str = "source"
    train_prop: float = 0.8
    seed: int = 42
    balance: str = "none"
    cap: int | None = None
    cap_tokens: int | None = None
    alpha: float = 1.0
    total: int | None = None
    #: actor view: a table of actors replaces the label map (see ``operators.actors.resolve_actors``)
    actors: DataFrame | None = None
    actor_view: str = "binary"
    unknown_actors: str = "drop"


def _written(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared scratch folder and read back (columns stay prunable)."""
    path = scratch_path(df.sparkSession, f"{name}-{uuid.uuid4().hex[:12]}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def filtered_docs(docs: DataFrame, p: PrepareParams, spark: SparkSession | None = None) -> DataFrame:
    """Length, tokens, modality, label mapping, unlabelled drop."""
    d = filters.filter_min_chars(docs, p.min_chars)
    d = filters.with_tokens(d, p.tokenizer)
    d = filters.filter_max_tokens(d, p.max_tokens)
    d = filters.filter_modality(d, p.modality)
    if p.label_map is not None:
        m = labels.label_map_frame(spark or docs.sparkSession, p.label_map)
        d = labels.apply_label_map(d, m, p.unknown_policy, p.other_label)
    return filters.drop_unlabelled(d)


def with_row_ids(df: DataFrame) -> DataFrame:
    """A frame without ``rid`` is written once with row numbers, so that they hold in every later pass."""
    if "rid" in df.columns:
        return df
    return _written(df.withColumn("rid", F.monotonically_increasing_id().cast("string")), "rows")


@dataclass
class Stages:
    """Key tables of a prepare run: ``seen`` (after the text filters), ``labelled`` and ``view`` (with ``split``)."""
    rows: DataFrame
    seen: DataFrame
    labelled: DataFrame
    view: DataFrame


def stages(docs: DataFrame, p: PrepareParams, add_labels: Callable[[DataFrame], DataFrame] | None = None, counted: bool = False) -> Stages:
    """Run the stage on ``docs`` (``id``, ``text``, ``modality``, ``source``, ``label_raw`` and a
    ``label`` unless ``add_labels`` attaches it to the narrow rows). ``counted``: the labelled
    rows are read again for counts, so they are written too."""
    rows = with_row_ids(docs)
    on = (p.dedup_on or "none").strip().lower()
    dedups = on not in ("none", "", "no")
    small = [c for c in rows.columns if c != "text"]
    keys = rows.select(*small, F.length("text").cast("bigint").alias("text_len"), token_count("text", p.tokenizer).cast("bigint").alias("tokens"),
                       *([dedup.dedup_key(on).alias("__k")] if dedups else []))
    seen = _written(keys, "seen")
    ok = seen
    if p.min_chars:
        ok = ok.where(F.col("text_len") >= int(p.min_chars))
    ok = filters.filter_max_tokens(ok, p.max_tokens)
    ok = filters.filter_modality(ok, p.modality)
    if add_labels is not None:
        ok = add_labels(ok)
    if p.actors is not None:
        ok = act.resolve_actors(ok.drop("label"), p.actors, p.actor_view, p.unknown_actors)
    elif p.label_map is not None:
        ok = labels.apply_label_map(ok, labels.label_map_frame(ok.sparkSession, p.label_map), p.unknown_policy, p.other_label)
    labelled = _written(ok, "labelled") if counted else ok
    view = filters.drop_unlabelled(labelled)
    if dedups:
        view = dedup.keep_first(view, F.col("__k"), "id", "id", row_id="rid")
    view = split.cap_rows(view.drop("__k"), p.max_docs, p.seed)
    view = filters.actor_include(view, p.actor_include, p.actor_col)
    view = filters.min_docs_per_group(view, p.actor_col, p.actor_min_docs)
    view = _written(split.stratified_split(view, p.train_prop, p.seed), "view")
    return Stages(rows, seen, labelled, view)


def balanced_view(view: DataFrame, p: PrepareParams) -> DataFrame:
    """The balance strategy on the train keys; job keys unchanged. Duplicates are further rows of
    the same ``rid`` with ``<id>#dup<k>`` ids."""
    if (p.balance or "none") == "none":
        return view
    train = view.where(F.col("split") == "train")
    job = view.where(F.col("split") == "job")
    bt = balance.apply_balance(train, p.balance, p.seed, cap=p.cap, cap_tokens_=p.cap_tokens, alpha=p.alpha, total=p.total)
    if "weight" in bt.columns:
        job = job.withColumn("weight", F.lit(None).cast("double"))
    return bt.withColumn("id", F.col("id").cast("string")).unionByName(job.withColumn("id", F.col("id").cast("string")))


def prepare_frame(docs: DataFrame, p: PrepareParams | None = None, balanced: bool = True, with_text: bool = True,
                  add_labels: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Train/job view of any documents frame (a table, a scanned TEI or TSV corpus, a union of corpora)."""
    p = p or PrepareParams()
    st = stages(docs, p, add_labels)
    keys = balanced_view(st.view, p) if balanced else st.view
    if not with_text:
        return keys
    text = st.rows.select(F.col("rid").alias("__rid"), "text")
    return keys.join(text, keys["rid"] == text["__rid"]).drop("__rid")


def prepare(spark: SparkSession, sf_dir: str, p: PrepareParams | None = None,
            balanced: bool = True, with_text: bool = True) -> DataFrame:
    """Train/job view over the driver tables: ``id, text, label, label_raw,
    modality, source, tokens, text_len, rid, split`` (+ ``weight`` for class weights)."""
    p = p or PrepareParams()
    return prepare_frame(document_rows(spark, sf_dir, row_id=True), p, balanced, with_text,
                         lambda keys: attach_labels(keys, spark, sf_dir, p.label_view))


def driver_stages(spark: SparkSession, sf_dir: str, p: PrepareParams) -> Stages:
    return stages(document_rows(spark, sf_dir, row_id=True), p, lambda keys: attach_labels(keys, spark, sf_dir, p.label_view), counted=True)


def view_meta(st: Stages, p: PrepareParams) -> DataFrame:
    """One-row stage counts of a prepare run."""
    ok_len = F.col("text_len") >= int(p.min_chars or 0)
    ok_tok = F.lit(True) if p.max_tokens is None else (F.col("tokens") <= int(p.max_tokens))
    seen = st.seen.agg(F.count(F.lit(1)).alias("n_seen"), F.count(F.when(ok_len, 1)).alias("n_after_length"),
                       F.count(F.when(ok_len & ok_tok, 1)).alias("n_after_tokens"))
    lab = st.labelled.agg(F.count(F.lit(1)).alias("n_after_modality"), F.count(F.when(F.col("label") != "", 1)).alias("n_labelled"))
    view = st.view.agg(F.count(F.lit(1)).alias("n_view"), F.count(F.when(F.col("split") == "train", 1)).alias("n_train"),
                       F.count(F.when(F.col("split") == "job", 1)).alias("n_job"))
    bal = balanced_view(st.view, p).agg(F.count(F.when(F.col("split") == "train", 1)).alias("n_train_balanced"))
    one = seen.join(lab, F.lit(True)).join(view, F.lit(True)).join(bal, F.lit(True))  # single rows
    return one.select("*", F.lit(float(p.train_prop)).alias("train_prop"), F.lit(int(p.seed)).cast("bigint").alias("seed"),
                      F.lit(p.dedup_on).alias("dedup_on"), F.lit(p.balance).alias("balance"))


def view_counts(st: Stages, p: PrepareParams) -> DataFrame:
    """``kind, key, n_docs``: modalities of all documents that pass the text filters, labels before
    and after dedup, per split and after balance, sources, and actor reasons."""
    ok = F.col("text_len") >= int(p.min_chars or 0)
    if p.max_tokens is not None:
        ok = ok & (F.col("tokens") <= int(p.max_tokens))
    bal = balanced_view(st.view, p)

    def count(df: DataFrame, kind, key) -> DataFrame:
        return df.groupBy((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), key.alias("key")).agg(F.count(F.lit(1)).alias("n_docs"))

    parts = [count(st.seen.where(ok), "modality", F.col("modality")), count(filters.drop_unlabelled(st.labelled), "label_before", F.col("label")),
             count(st.view, "label_view", F.col("label")), count(st.view, F.concat(F.lit("label_"), F.col("split")), F.col("label")),
             count(bal.where("split = 'train'"), "label_train_balanced", F.col("label")), count(st.view, "source", F.col(p.actor_col))]
    if "reason" in st.labelled.columns:
        parts.append(count(st.labelled, "reason", F.col("reason")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def write_view_meta(st: Stages, p: PrepareParams, path: str) -> str:
    """The stage counts and the per-key counts as JSON lines."""
    counts = view_counts(st, p)
    per = counts.groupBy("kind").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("key", F.lit("")), "n_docs")))).alias("counts"))
    view_meta(st, p).select(F.lit("stages").alias("kind"), F.to_json(F.struct("*")).alias("value")).unionByName(
        per.select("kind", F.to_json("counts").alias("value"))).coalesce(1).write.mode("overwrite").json(path)
    return path
