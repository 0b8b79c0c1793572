"""Registered queries: rebalancing, caps, samples, label shuffle, id sets, leakage."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessel.functions.text import dedup_text_key
from tessel.operators import balance as B
from tessel.operators import dedup as D
from tessel.operators import filters as FL
from tessel.operators import split as S
from tessel.plans import sql as Q
from tessel.plans.prepare import PrepareParams, filtered_docs, prepare
from tessel.plans.registry import query
from tessel.sources.tables import labelled_docs, read_table

PREP = Q.prepared()
H = Q.order_key("id")
TRAIN = "tr AS (SELECT * FROM v WHERE split = 'train')"
CAP, OVERSAMPLE_CAP, CAP_TOKENS, ALPHA, TOTAL = 100, 150, 30000, 0.5, 200


def _train(spark, sf):
    return prepare(spark, sf, with_text=False).where(F.col("split") == "train")


def _extras_sql(need_cte: str, ranked: str) -> str:
    """Extras with replacement: draw k of label picks rank 1 + H(seed:label:k) mod n."""
    return f"""dr AS (SELECT label, n, k, 1 + ('0x' || substr(md5('42:' || label || ':' || CAST(k AS VARCHAR)), 1, 15))::BIGINT % n AS pick
        FROM {need_cte}, range(1, need + 1) t(k) WHERE need > 0),
ex AS (SELECT CAST(r.id AS VARCHAR) || '#dup' || CAST(dr.k AS VARCHAR) AS id, r.label FROM {ranked} r JOIN dr ON r.label = dr.label AND r.r = dr.pick)"""


RANKED = f"rk AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {H}, id) AS r, count(*) OVER (PARTITION BY label) AS n FROM tr)"


@query("balance_cap_docs", f"WITH {PREP}, {TRAIN}, {RANKED} SELECT CAST(id AS VARCHAR) AS id, label FROM rk WHERE r <= {CAP}")
def q_cap_docs(spark, sf):
    return B.cap_docs(_train(spark, sf), CAP, 42).select("id", "label")


@query("balance_oversample", f"""WITH {PREP}, {TRAIN}, {RANKED},
nd AS (SELECT DISTINCT label, n, greatest({OVERSAMPLE_CAP} - n, 0) AS need FROM rk),
{_extras_sql('nd', 'rk')}
SELECT CAST(id AS VARCHAR) AS id, label FROM rk WHERE r <= {OVERSAMPLE_CAP} UNION ALL SELECT id, label FROM ex""")
def q_oversample(spark, sf):
    return B.cap_docs(_train(spark, sf), OVERSAMPLE_CAP, 42, oversample=True).select("id", "label")


@query("balance_oversample_max", f"""WITH {PREP}, {TRAIN}, {RANKED},
nd AS (SELECT label, n, max(n) OVER () - n AS need FROM (SELECT DISTINCT label, n FROM rk)),
{_extras_sql('nd', 'rk')}
SELECT CAST(id AS VARCHAR) AS id, label FROM rk UNION ALL SELECT id, label FROM ex""")
def q_oversample_max(spark, sf):
    return B.oversample_to_max(_train(spark, sf), 42).select("id", "label")


@query("balance_cap_tokens", f"""WITH {PREP}, {TRAIN},
r AS (SELECT id, label, tokens, row_number() OVER w AS r,
             coalesce(sum(tokens) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pre,
             sum(tokens) OVER (PARTITION BY label) AS tt
      FROM tr WINDOW w AS (PARTITION BY label ORDER BY {H}, id))
SELECT CAST(id AS VARCHAR) AS id, label FROM r WHERE pre < {CAP_TOKENS}
UNION ALL SELECT CAST(id AS VARCHAR) || '#dup' || CAST(r AS VARCHAR), label FROM r WHERE tt < {CAP_TOKENS} AND tt + pre < {CAP_TOKENS}""")
def q_cap_tokens(spark, sf):
    return B.cap_tokens(_train(spark, sf), CAP_TOKENS, 42).select("id", "label")


def quotas_sql(total: int = TOTAL, alpha: float = ALPHA) -> str:
    return f"""c AS (SELECT label, count(*) AS n_docs FROM tr GROUP BY label),
q AS (SELECT label, n_docs, greatest(1, CAST(round_even({float(total)} * (pow(n_docs, {alpha}) / sum(pow(n_docs, {alpha})) OVER ()), 0) AS BIGINT)) AS q0,
             row_number() OVER (ORDER BY label) - 1 AS i, count(*) OVER () AS nl FROM c),
qk AS (SELECT *, {total} - sum(q0) OVER () AS d, row_number() OVER (ORDER BY q0 DESC, label) AS k,
              coalesce(sum(q0) OVER (ORDER BY q0 DESC, label ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0) AS rest FROM q),
qt AS (SELECT *, max(CAST(floor(({total} - rest) / k) AS BIGINT)) OVER () AS t FROM qk),
ql AS (SELECT *, {total} - sum(least(q0, t)) OVER () AS lft, sum(CASE WHEN q0 > t THEN 1 ELSE 0 END) OVER (ORDER BY label ROWS UNBOUNDED PRECEDING) AS j FROM qt),
quotas AS (SELECT label, n_docs, CAST(CASE WHEN d >= 0 THEN q0 + d // nl + CASE WHEN i < d % nl THEN 1 ELSE 0 END
                  ELSE least(q0, t) + CASE WHEN q0 > t AND j <= lft THEN 1 ELSE 0 END END AS BIGINT) AS quota FROM ql)"""


QUOTAS = quotas_sql()
# one big label and many rare ones: every language x source is a label, the total little above their number
RARE = "tr AS (SELECT id, modality || '-' || source || CASE WHEN id % 50 = 0 THEN '-' || id ELSE '' END AS label FROM docs)"
RARE_TOTAL = 400


@query("alpha_quotas_rare", f"WITH {Q.DOCS}, {RARE}, {quotas_sql(RARE_TOTAL, 1.0)} SELECT * FROM quotas")
def q_alpha_quotas_rare(spark, sf):
    """Rare labels keep a quota of one; the excess comes from the largest. With more labels than quotas the first ones get them."""
    d = labelled_docs(spark, sf, with_text=False)
    label = F.concat("modality", F.lit("-"), "source", F.when(F.col("id") % 50 == 0, F.concat(F.lit("-"), F.col("id").cast("string"))).otherwise(""))
    return B.alpha_quotas(d.select("id", label.alias("label")), 1.0, RARE_TOTAL, may_drop=True)


@query("alpha_quotas", f"WITH {PREP}, {TRAIN}, {QUOTAS} SELECT * FROM quotas")
def q_alpha_quotas(spark, sf):
    return B.alpha_quotas(_train(spark, sf), ALPHA, TOTAL)


@query("balance_alpha_total", f"""WITH {PREP}, {TRAIN}, {QUOTAS}, {RANKED},
nd AS (SELECT DISTINCT rk.label, rk.n, greatest(quotas.quota - rk.n, 0) AS need FROM rk JOIN quotas USING (label)),
{_extras_sql('nd', 'rk')}
SELECT CAST(id AS VARCHAR) AS id, label FROM rk JOIN quotas USING (label) WHERE r <= quota
UNION ALL SELECT id, label FROM ex""")
def q_alpha_total(spark, sf):
    return B.alpha_total(_train(spark, sf), ALPHA, TOTAL, 42).select("id", "label")


@query("balance_class_weights", f"""WITH {PREP}, {TRAIN}, c AS (SELECT label, count(*) AS n FROM tr GROUP BY label),
w AS (SELECT label, sum(n) OVER () / (count(*) OVER () * n) AS weight FROM c)
SELECT CAST(id AS VARCHAR) AS id, label, round(weight, 6) AS weight FROM tr JOIN w USING (label)""")
def q_balance_class_weights(spark, sf):
    t = B.apply_balance(_train(spark, sf), "class_weights")
    return t.select(F.col("id").cast("string").alias("id"), "label", F.round("weight", 6).alias("weight"))


@query("max_docs", f"SELECT id, label FROM (WITH {PREP} SELECT * FROM dd) ORDER BY {H}, id LIMIT 120")
def q_max_docs(spark, sf):
    p = PrepareParams()
    d = D.dedup(filtered_docs(labelled_docs(spark, sf), p, spark), "text")
    return S.cap_rows(d, 120, 42).select("id", "label")


@query("train_cap", f"SELECT id, label FROM (WITH {PREP} SELECT * FROM v WHERE split = 'train') ORDER BY {Q.order_key('id', 7)}, id LIMIT 150")
def q_train_cap(spark, sf):
    return S.cap_rows(_train(spark, sf), 150, 7).select("id", "label")


@query("debug_sample", f"SELECT doc_id AS id FROM documents ORDER BY {Q.order_key('doc_id', 1000)}, doc_id LIMIT 250")
def q_debug_sample(spark, sf):
    d = read_table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return S.cap_rows(d, 250, 1000)


@query("shuffle_labels", f"""WITH {PREP},
a AS (SELECT id, label, row_number() OVER (ORDER BY {Q.order_key('id', 42, 'a')}, id) AS r FROM v),
b AS (SELECT label AS label_shuffled, row_number() OVER (ORDER BY {Q.order_key('id', 42, 'b')}, id) AS r FROM v)
SELECT a.id, a.label, b.label_shuffled FROM a JOIN b USING (r)""")
def q_shuffle_labels(spark, sf):
    return S.shuffle_labels(prepare(spark, sf, with_text=False), 42).select("id", "label", "label_shuffled")


@query("keep_ids_semi", "SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def q_keep_ids(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id")
    k = read_table(spark, sf, "labels").select("doc_id")
    return d.join(k, "doc_id", "left_semi").select(F.col("doc_id").alias("id"))


@query("drop_ids_anti", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def q_drop_ids(spark, sf):
    d = read_table(spark, sf, "documents").select("doc_id")
    k = read_table(spark, sf, "labels").select("doc_id")
    return d.join(k, "doc_id", "left_anti").select(F.col("doc_id").alias("id"))


@query("split_leak_exact", f"""WITH {Q.prepared(dedup=False)}
SELECT {Q.dedup_key()} AS text_key FROM v WHERE split = 'train'
INTERSECT SELECT {Q.dedup_key()} FROM v WHERE split = 'job'""")
def q_split_leak(spark, sf):
    v = prepare(spark, sf, PrepareParams(dedup_on="none")).select("split", dedup_text_key("text").alias("text_key"))
    return (v.where("split = 'train'").select("text_key")
            .intersect(v.where("split = 'job'").select("text_key")))


@query("actor_include", f"WITH {Q.DOCS} SELECT id, source FROM docs WHERE source IN ('src1', 'src4', 'src9')")
def q_actor_include(spark, sf):
    return FL.actor_include(labelled_docs(spark, sf), ["src1", "src4", "src9"], "source").select("id", "source")


@query("min_docs_group", f"""WITH {Q.DOCS}, l AS (SELECT * FROM docs WHERE label IS NOT NULL)
SELECT id, source FROM l WHERE source IN (SELECT source FROM l GROUP BY source HAVING count(*) >= 20)""")
def q_min_docs_group(spark, sf):
    d = labelled_docs(spark, sf).where(F.col("label").isNotNull())
    return FL.min_docs_per_group(d, "source", 20).select("id", "source")
