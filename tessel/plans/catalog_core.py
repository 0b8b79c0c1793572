"""Registered queries: prepare stage, text scalars, dedup, split, counts, metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions import text as T
from tessel.operators import aggregates as A
from tessel.operators import balance as B
from tessel.operators import dedup as D
from tessel.operators import filters as FL
from tessel.operators import labels as L
from tessel.operators import metrics as M
from tessel.operators import split as S
from tessel.plans import sql as Q
from tessel.plans.prepare import PrepareParams, driver_stages, prepare, prepare_frame, view_counts, view_meta
from tessel.plans.registry import query
from tessel.sources.tables import labelled_docs, read_table

PREP = Q.prepared()
SEL_V = "id, label, label_raw, modality, source, tokens, split"

# Fixed inputs of the label-mapping queries (raw source names in mixed spellings).
LABEL_MAP = {
    "SRC0": "news", "src 1": "news", "Src/2": "forum", "src-3": "forum",
    "src4": "blog", "src_5": "blog", "src6": "", "src7": None, "SRC7": "wiki",
    "src8": "wiki", "src9": "news", "src10": "forum",
}
LABEL_MAP_SQL = ", ".join(
    f"({i}, '{k}', {'NULL' if v is None else repr(v)})" for i, (k, v) in enumerate(LABEL_MAP.items()))


def _v(spark, sf):
    """The split view's key rows: everything but the text."""
    return prepare(spark, sf, with_text=False)


def _v_keys(spark, sf):
    """The split view without text (a written table): metric queries read it
    several times (train counts, the majority subquery, job rows)."""
    return prepare(spark, sf, with_text=False).select("id", "label", "source", "modality", "split")


@query("prepare_view", f"WITH {PREP} SELECT {SEL_V}, md5(text) AS text_md5 FROM v")
def q_prepare_view(spark, sf):
    return prepare(spark, sf).select(*[c.strip() for c in SEL_V.split(",")], F.md5("text").alias("text_md5"))


@query("filter_length", f"WITH {Q.DOCS} SELECT id, CAST(length(text) AS BIGINT) AS n_chars FROM docs WHERE length(text) >= 200")
def q_filter_length(spark, sf):
    d = FL.filter_min_chars(labelled_docs(spark, sf), 200)
    return d.select("id", F.length("text").cast("bigint").alias("n_chars"))


@query("filter_tokens", f"WITH {Q.DOCS}, t AS (SELECT id, {Q.tok_split()} AS tokens FROM docs) "
       "SELECT id, tokens FROM t WHERE tokens <= 400")
def q_filter_tokens(spark, sf):
    d = FL.with_tokens(labelled_docs(spark, sf))
    return FL.filter_max_tokens(d, 400).select("id", "tokens")


@query("token_counts", rf"""WITH {Q.DOCS}
SELECT id, {Q.tok_split()} AS tok_split,
       len(list_filter(string_split(replace(text, chr(10), ' '), ' '), lambda x: x <> '')) AS tok_simple,
       len(regexp_extract_all(text, '[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_\s]')) AS tok_regex
FROM docs""")
def q_token_counts(spark, sf):
    d = labelled_docs(spark, sf)
    return d.select("id", *[T.token_count("text", k).cast("bigint").alias(f"tok_{k}")
                            for k in ("split", "simple", "regex")])


@query("modality_counts", f"WITH {Q.DOCS} SELECT modality, count(*) AS n_docs FROM docs "
       "WHERE length(text) >= 200 GROUP BY modality")
def q_modality_counts(spark, sf):
    return FL.modality_counts(FL.filter_min_chars(labelled_docs(spark, sf), 200))


def _label_map_sql(policy: str, fallback: str) -> str:
    return f"""WITH {Q.DOCS},
raw(pos, raw_key, label) AS (VALUES {LABEL_MAP_SQL}),
m AS (SELECT {Q.norm_label('raw_key')} AS key, arg_max(label, pos) AS label FROM raw
      WHERE label IS NOT NULL AND trim(label) <> '' GROUP BY 1),
j AS (SELECT docs.id, docs.label_raw, {Q.norm_label('docs.label_raw')} AS rn, m.label AS mapped
      FROM docs LEFT JOIN m ON {Q.norm_label('docs.label_raw')} = m.key)
SELECT id, label_raw, CASE WHEN label_raw IS NULL THEN NULL
                           ELSE coalesce(CASE WHEN mapped <> '' THEN mapped END, {fallback}) END AS label FROM j"""


def _label_map_q(policy):
    def fn(spark, sf):
        d = labelled_docs(spark, sf).select("id", "label_raw")
        m = L.label_map_frame(spark, LABEL_MAP)
        return L.apply_label_map(d, m, policy, "other").select("id", "label_raw", "label")
    return fn


query("label_map_join", _label_map_sql("other", "'other'"))(_label_map_q("other"))
query("label_map_keep", _label_map_sql("keep", "rn"))(_label_map_q("keep"))
query("label_map_drop", _label_map_sql("drop", "NULL"))(_label_map_q("drop"))


@query("label_fallback", f"""WITH {Q.DOCS}
SELECT id, coalesce(CASE WHEN trim(label) <> '' THEN trim(label) END,
                    CASE WHEN trim(modality) <> '' THEN trim(modality) END) AS label_raw FROM docs""")
def q_label_fallback(spark, sf):
    d = labelled_docs(spark, sf).drop("label_raw")
    return L.label_fallback(d, ["label", "modality"]).select("id", "label_raw")


def _scalar_sql(expr: str) -> str:
    return f"WITH {Q.DOCS}, k AS (SELECT id, {expr} AS k FROM docs) SELECT id, md5(k) AS key_md5, CAST(length(k) AS BIGINT) AS key_len FROM k"


def _scalar_q(fn):
    def run(spark, sf):
        d = labelled_docs(spark, sf).select("id", fn("text").alias("k"))
        return d.select("id", F.md5("k").alias("key_md5"), F.length("k").cast("bigint").alias("key_len"))
    return run


query("norm_label", _scalar_sql(Q.norm_label("text")))(_scalar_q(T.norm_label))
query("norm_key", _scalar_sql(
    r"regexp_replace(regexp_replace(strip_accents(trim(lower(coalesce(text, '')))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
))(_scalar_q(T.norm_key))
query("norm_key_ws", _scalar_sql(
    r"regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace(text, '^\s+|\s+$', '', 'g')), '[ \t\n]', '_', 'g'), '_{2,}', '_', 'g'), '^_+|_+$', '', 'g')"
))(_scalar_q(T.norm_key_ws))
query("norm_text", _scalar_sql(
    r"trim(regexp_replace(replace(replace(replace(coalesce(text, ''), chr(160), ' '), chr(9) || ' _blank', ' '), chr(8203), ''), '\s+', ' ', 'g'))"
))(_scalar_q(T.norm_text))


@query("dedup_text", f"WITH {Q.DOCS} SELECT id FROM docs QUALIFY row_number() OVER (PARTITION BY {Q.dedup_key()} ORDER BY id) = 1")
def q_dedup_text(spark, sf):
    return D.dedup(labelled_docs(spark, sf), "text").select("id")


@query("dedup_id", f"WITH {Q.DOCS} SELECT id FROM docs QUALIFY row_number() OVER (PARTITION BY CAST(id AS VARCHAR) ORDER BY id) = 1")
def q_dedup_id(spark, sf):
    return D.dedup(labelled_docs(spark, sf), "id").select("id")


@query("dedup_id_and_text", rf"""WITH {Q.DOCS} SELECT id FROM docs QUALIFY row_number() OVER (
  PARTITION BY md5(trim(CAST(id AS VARCHAR)) || '||' || lower(trim(regexp_replace(text, '\s+', ' ', 'g')))) ORDER BY id) = 1""")
def q_dedup_id_and_text(spark, sf):
    return D.dedup(labelled_docs(spark, sf), "id_and_text").select("id")


@query("stratified_split", f"WITH {PREP} SELECT id, label, split FROM v")
def q_stratified_split(spark, sf):
    return _v(spark, sf).select("id", "label", "split")


@query("label_counts", f"WITH {PREP} SELECT label, count(*) AS n_docs FROM v GROUP BY label")
def q_label_counts(spark, sf):
    return A.counts(_v(spark, sf), "label")


@query("split_counts", f"WITH {PREP} SELECT split, label, count(*) AS n_docs FROM v GROUP BY split, label")
def q_split_counts(spark, sf):
    return A.counts(_v(spark, sf), ["split", "label"])


@query("class_weights", f"""WITH {PREP}, c AS (SELECT label, count(*) AS n_docs FROM v WHERE split = 'train' GROUP BY label)
SELECT label, n_docs, round(sum(n_docs) OVER () / (count(*) OVER () * n_docs), 6) AS weight FROM c""")
def q_class_weights(spark, sf):
    w = B.class_weights(_v(spark, sf).where("split = 'train'"))
    return w.withColumn("weight", F.round("weight", 6))


@query("check_stats", f"""WITH {PREP}, c AS (SELECT label, count(*) AS n_docs FROM v WHERE split = 'train' GROUP BY label)
SELECT label, n_docs, CAST(sum(n_docs) OVER () AS BIGINT) AS docs, count(*) OVER () AS n_labels FROM c""")
def q_check_stats(spark, sf):
    return A.check_stats(_v(spark, sf).where("split = 'train'"))


_NT = r"trim(regexp_replace(replace(replace(replace(coalesce(text, ''), chr(160), ' '), chr(9) || ' _blank', ' '), chr(8203), ''), '\s+', ' ', 'g'))"


@query("corpus_stats", f"""WITH {Q.DOCS},
x AS (SELECT id, trim(label) AS label, {_NT} AS t FROM docs),
y AS (SELECT id, label, md5(t) AS m, len(string_split(t, ' ')) AS tok FROM x WHERE t <> '' AND label <> ''),
z AS (SELECT *, row_number() OVER (PARTITION BY m ORDER BY id) AS occ FROM y)
SELECT label, count(*) AS n_docs, CAST(sum(CASE WHEN occ > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_dups,
       round(quantile_cont(tok, 0.5), 6) AS median_tokens, round(quantile_cont(tok, 0.9), 6) AS p90_tokens
FROM z GROUP BY label""")
def q_corpus_stats(spark, sf):
    d = labelled_docs(spark, sf).where(F.col("label").isNotNull())
    return A.corpus_stats(d)


@query("length_stats", f"""WITH {PREP}, x AS (SELECT label, split, CAST(length(text) AS DOUBLE) AS l FROM v),
g AS (SELECT label, split, grouping(label, split) AS gid, count(*) AS n, min(l) AS "min", max(l) AS "max",
             round(avg(l), 6) AS mean, round(stddev_samp(l), 6) AS std,
             quantile_cont(l, [0.01, 0.05, 0.25, 0.5, 0.75, 0.95, 0.99]) AS q,
             round(avg(CASE WHEN l < 200 THEN 1.0 ELSE 0.0 END), 6) AS share_lt_200,
             round(avg(CASE WHEN l > 5000 THEN 1.0 ELSE 0.0 END), 6) AS share_gt_5000
      FROM x GROUP BY GROUPING SETS ((label, split), ()))
SELECT CASE WHEN gid = 0 THEN 'by_group' ELSE 'all' END AS scope, label, split, n, "min",
       round(q[1], 6) AS p01, round(q[2], 6) AS p05, round(q[3], 6) AS p25, round(q[4], 6) AS median,
       round(q[5], 6) AS p75, round(q[6], 6) AS p95, round(q[7], 6) AS p99, "max", mean, std,
       share_lt_200, share_gt_5000 FROM g""")
def q_length_stats(spark, sf):
    return A.length_stats(_v(spark, sf), "text_len", ("label", "split"))


_DOMAIN_SQL = r"regexp_replace(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '^www\.', '')"


@query("top_domains", f"""SELECT domain, count(*) AS n_docs FROM (SELECT {_DOMAIN_SQL} AS domain FROM pages)
WHERE domain IS NOT NULL GROUP BY domain ORDER BY n_docs DESC, domain LIMIT 20""")
def q_top_domains(spark, sf):
    p = read_table(spark, sf, "pages").select(T.url_domain("url").alias("domain"))
    return A.top_values(p, "domain", 20)


@query("top_languages", f"WITH {Q.DOCS} SELECT modality, count(*) AS n_docs FROM docs "
       "GROUP BY modality ORDER BY n_docs DESC, modality LIMIT 20")
def q_top_languages(spark, sf):
    return A.top_values(labelled_docs(spark, sf, with_text=False), "modality", 20)


@query("classification_report", f"WITH {PREP}, {Q.source_majority_pred()}, {Q.report()} SELECT * FROM rep")
def q_classification_report(spark, sf):
    return M.classification_report(M.source_majority_predictions(_v_keys(spark, sf)))


@query("baseline_source_majority", f"WITH {PREP}, {Q.source_majority_pred()}, {Q.report()} {Q.summary()}")
def q_baseline_source_majority(spark, sf):
    rep = M.classification_report(M.source_majority_predictions(_v_keys(spark, sf)))
    return M.summary_metrics(rep)


@query("baseline_majority", f"""WITH {PREP},
gmaj AS (SELECT label AS majority FROM v WHERE split = 'train' GROUP BY label ORDER BY count(*) DESC, label LIMIT 1),
pred AS (SELECT v.label AS y_true, gmaj.majority AS y_pred FROM v, gmaj WHERE v.split = 'job'),
{Q.report()} SELECT * FROM rep""")
def q_baseline_majority(spark, sf):
    return M.classification_report(M.baseline_majority(_v_keys(spark, sf)))


_GROUP_FIELDS = ("modality", "source")


@query("metrics_by_group", f"""WITH {PREP}, {Q.source_majority_pred()},
j AS (SELECT pred.*, v.modality FROM pred JOIN v USING (id)),
g AS (SELECT 'modality' AS group_field, coalesce(CAST(modality AS VARCHAR), '__missing__') AS group_value, y_true, y_pred FROM j
      UNION ALL SELECT 'source', coalesce(CAST(source AS VARCHAR), '__missing__'), y_true, y_pred FROM j),
{Q.report('g', ('group_field', 'group_value'))} SELECT * FROM rep""")
def q_metrics_by_group(spark, sf):
    v = _v_keys(spark, sf)
    p = M.source_majority_predictions(v).join(v.select("id", "modality"), "id")
    return M.metrics_by_group(p, list(_GROUP_FIELDS))


@query("source_purity", f"""WITH {PREP},
per AS (SELECT source, label, count(*) AS c FROM v GROUP BY ALL),
site AS (SELECT source, sum(c) AS n, max(c) AS m, max(c) / sum(c) AS purity FROM per GROUP BY source)
SELECT count(*) AS n_sources, CAST(sum(CASE WHEN purity >= 1.0 THEN 1 ELSE 0 END) AS BIGINT) AS n_pure,
       CAST(sum(CASE WHEN purity >= 0.95 THEN 1 ELSE 0 END) AS BIGINT) AS n_ge95,
       round(avg(purity), 6) AS mean_purity, round(min(purity), 6) AS min_purity,
       round(sum(CASE WHEN purity >= 1.0 THEN n ELSE 0 END) / sum(n), 6) AS docs_share_pure,
       round(sum(CASE WHEN purity >= 0.95 THEN n ELSE 0 END) / sum(n), 6) AS docs_share_ge95 FROM site""")
def q_source_purity(spark, sf):
    return A.source_purity(_v(spark, sf))


@query("crosstab_source_label", f"""WITH {PREP}, per AS (SELECT source, label, count(*) AS n_docs FROM v GROUP BY ALL)
SELECT source, label, n_docs, round(n_docs / sum(n_docs) OVER (PARTITION BY source), 6) AS share FROM per""")
def q_crosstab(spark, sf):
    return A.crosstab_share(_v(spark, sf), "source")


@query("split_label_shift", f"""WITH {PREP},
per AS (SELECT label, sum(CASE WHEN split = 'train' THEN 1 ELSE 0 END) AS a, sum(CASE WHEN split = 'job' THEN 1 ELSE 0 END) AS b
        FROM v GROUP BY label),
s AS (SELECT label, a, b, a / sum(a) OVER () AS sa, b / sum(b) OVER () AS sb FROM per)
SELECT label, CAST(a AS BIGINT) AS n_train, CAST(b AS BIGINT) AS n_job, round(sa, 6) AS share_train,
       round(sb, 6) AS share_job, round(sa - sb, 6) AS shift FROM s""")
def q_split_label_shift(spark, sf):
    return A.split_label_shift(_v(spark, sf))


@query("dup_multiplicity", f"""WITH {Q.DOCS},
k AS (SELECT 'text_md5' AS key_kind, {Q.dedup_key()} AS k FROM docs
      UNION ALL SELECT 'url', url FROM pages),
per AS (SELECT key_kind, k, count(*) AS c FROM k WHERE k IS NOT NULL GROUP BY ALL)
SELECT key_kind, count(*) AS n_unique, CAST(sum(CASE WHEN c >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_multi,
       CAST(coalesce(sum(c - 1), 0) AS BIGINT) AS excess_docs FROM per GROUP BY key_kind""")
def q_dup_multiplicity(spark, sf):
    d = labelled_docs(spark, sf).select(T.dedup_text_key("text").alias("k"))
    u = read_table(spark, sf, "pages").select(F.col("url").alias("k"))
    a = D.multiplicity(d, "k").withColumn("key_kind", F.lit("text_md5"))
    b = D.multiplicity(u, "k").withColumn("key_kind", F.lit("url"))
    return a.unionByName(b)


@query("exact_dups", f"""WITH {PREP},
x AS (SELECT coalesce(s.split, 'unsplit') AS split, {Q.dedup_key()} AS k FROM f LEFT JOIN (SELECT id, split FROM v) s USING (id)),
c AS (SELECT split, count(*) OVER (PARTITION BY k) AS t FROM x)
SELECT split, count(*) AS n_docs, CAST(sum(CASE WHEN t > 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_dup_docs,
       round(sum(CASE WHEN t > 1 THEN 1 ELSE 0 END) / count(*), 6) AS dup_share FROM c GROUP BY split""")
def q_exact_dups(spark, sf):
    st = driver_stages(spark, sf, PrepareParams())
    f = FL.drop_unlabelled(st.labelled).select("rid", F.col("__k").alias("k"))
    x = f.join(st.view.select("rid", "split"), "rid", "left").select(F.coalesce("split", F.lit("unsplit")).alias("split"), "k")
    return D.exact_duplicates(x, "k", "split")


def _meta_sql(where: str = "TRUE", label: str = "label", dedup: bool = True) -> str:
    """Key rows of every stage: t (all), l (after text filters and modality), v (split)."""
    return f"""{Q.DOCS}, t AS (SELECT *, {Q.tok_split()} AS tokens, {Q.dedup_key()} AS k FROM docs),
l AS (SELECT * EXCLUDE (label), {label} AS label FROM t WHERE length(text) >= 200 AND {where}),
w AS (SELECT * FROM l WHERE label IS NOT NULL AND label <> '' QUALIFY row_number() OVER (PARTITION BY k ORDER BY id) = 1),
v AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {Q.order_key('id')}, id)
                     <= round_even(0.8::DOUBLE * count(*) OVER (PARTITION BY label), 0) THEN 'train' ELSE 'job' END AS split FROM w)"""


def _meta_q(name: str, where: str, label: str, params: dict, balance_cap: int):
    """Stage counts and per-key counts of one parameter set."""
    bal = f"bal AS (SELECT * FROM v WHERE split = 'train' QUALIFY row_number() OVER (PARTITION BY label ORDER BY {Q.order_key('id')}, id) <= {balance_cap})"
    p = {**params, "balance": "cap_docs", "cap": balance_cap}

    @query(name, f"""WITH {_meta_sql(where, label)}, {bal}
SELECT (SELECT count(*) FROM t) AS n_seen, (SELECT count(*) FROM t WHERE length(text) >= 200) AS n_after_length,
       (SELECT count(*) FROM t WHERE length(text) >= 200) AS n_after_tokens, (SELECT count(*) FROM l) AS n_after_modality,
       (SELECT count(*) FROM l WHERE label <> '') AS n_labelled, (SELECT count(*) FROM v) AS n_view,
       (SELECT count(*) FROM v WHERE split = 'train') AS n_train, (SELECT count(*) FROM v WHERE split = 'job') AS n_job,
       (SELECT count(*) FROM bal) AS n_train_balanced, 0.8::DOUBLE AS train_prop, CAST(42 AS BIGINT) AS seed, 'text' AS dedup_on, 'cap_docs' AS balance""")
    def meta(spark, sf):
        q = PrepareParams(**p)
        return view_meta(driver_stages(spark, sf, q), q)

    @query(f"{name}_counts", f"""WITH {_meta_sql(where, label)}, {bal}
SELECT 'modality' AS kind, modality AS key, count(*) AS n_docs FROM t WHERE length(text) >= 200 GROUP BY ALL
UNION ALL SELECT 'label_before', label, count(*) FROM l WHERE label <> '' GROUP BY ALL
UNION ALL SELECT 'label_view', label, count(*) FROM v GROUP BY ALL
UNION ALL SELECT 'label_' || split, label, count(*) FROM v GROUP BY ALL
UNION ALL SELECT 'label_train_balanced', label, count(*) FROM bal GROUP BY ALL
UNION ALL SELECT 'source', source, count(*) FROM v GROUP BY ALL""")
    def counts(spark, sf):
        q = PrepareParams(**p)
        return view_counts(driver_stages(spark, sf, q), q)


_FIVE = {f"src{i}": ("left" if i % 2 else "right") for i in range(5)}
_FIVE_SQL = "CASE " + " ".join(f"WHEN label_raw = '{k}' THEN '{v}'" for k, v in _FIVE.items()) + " END"
_meta_q("view_meta", "TRUE", "label", {}, 60)
_meta_q("view_meta_modality", "modality = 'en'", "label", {"modality": "en"}, 60)
_meta_q("view_meta_label_map", "TRUE", _FIVE_SQL, {"label_map": _FIVE}, 60)


# Repeated and missing ids: a conversation's turns share its id, every seventh conversation has none.
_CONV = "cv AS (SELECT CASE WHEN conv_id % 7 <> 0 THEN conv_id END AS id, turn, role, text FROM conversations)"


def _conv_rows(spark, sf):
    return read_table(spark, sf, "conversations", row_id=True).select(F.when(F.col("conv_id") % 7 != 0, F.col("conv_id")).alias("id"), "turn", "role", "text", "rid")


def _conv_dedup(mode: str, key: str):
    @query(f"dedup_conv_{mode}", f"""WITH {_CONV} SELECT id, turn, role, md5(text) AS text_md5 FROM cv
QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY turn, id NULLS FIRST, md5(text)) = 1""")
    def run(spark, sf):
        d = D.dedup(_conv_rows(spark, sf).drop("rid"), mode, "turn")
        return d.select("id", "turn", "role", F.md5("text").alias("text_md5"))


_conv_dedup("id", "coalesce(CAST(id AS VARCHAR), text)")
_conv_dedup("text", Q.dedup_key())
_conv_dedup("id_and_text", f"coalesce(CAST(id AS VARCHAR), '') || '||' || {Q.dedup_key()}")


@query("prepare_repeated_ids", f"""WITH {_CONV},
f AS (SELECT *, {Q.dedup_key()} AS k FROM cv WHERE length(text) >= 50)
SELECT role AS label, count(*) AS n_docs, count(DISTINCT md5(text)) AS n_texts,
       CAST(round_even(0.8::DOUBLE * count(*), 0) AS BIGINT) AS n_train FROM f GROUP BY role""")
def q_prepare_repeated_ids(spark, sf):
    """Any frame through the stage: rows stay rows whatever their ids (no dedup)."""
    d = _conv_rows(spark, sf).select("rid", "id", "text", F.col("role").alias("label"), F.lit("chat").alias("modality"), F.lit("chat").alias("source"))
    v = prepare_frame(d, PrepareParams(min_chars=50, dedup_on="none"))
    return v.groupBy("label").agg(F.count(F.lit(1)).alias("n_docs"), F.countDistinct(F.md5("text")).alias("n_texts"),
                                  F.count(F.when(F.col("split") == "train", 1)).alias("n_train"))
