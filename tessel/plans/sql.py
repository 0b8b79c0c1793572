"""Reusable DuckDB SQL fragments for the oracle statements.

These restate, in plain SQL with window functions, what the Spark plans
compute with bucketed ranks and pre-aggregations; the two must agree.
"""

from __future__ import annotations

DOCS = r"""docs AS (
  SELECT d.doc_id AS id, d.text, d.lang AS modality, d.source, d.source AS label_raw,
         CASE WHEN l.quality = 1 THEN 'good' WHEN l.quality = 0 THEN 'bad' END AS label
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


def tok_split(col: str = "text") -> str:
    return rf"len(list_filter(regexp_split_to_array({col}, '\s+'), lambda x: x <> ''))"


def dedup_key(col: str = "text") -> str:
    return rf"md5(lower(trim(regexp_replace({col}, '\s+', ' ', 'g'))))"


def norm_label(col: str) -> str:
    s = rf"regexp_replace(lower({col}), '[\s/\\]+', '_', 'g')"
    s = rf"regexp_replace({s}, '[^0-9a-zA-Z_]+', '_', 'g')"
    s = rf"regexp_replace({s}, '_+', '_', 'g')"
    return rf"regexp_replace({s}, '^_|_$', '', 'g')"


def order_key(id_col: str = "id", seed: int = 42, *extra) -> str:
    parts = " || ':' || ".join([f"'{seed}'", f"CAST({id_col} AS VARCHAR)", *[f"'{e}'" for e in extra]])
    return f"md5({parts})"


def prepared(min_chars: int = 200, p: float = 0.8, seed: int = 42, dedup: bool = True) -> str:
    """CTEs ``docs``, ``f`` (filtered + tokens), ``dd`` (deduped), ``v`` (split)."""
    dd = (f"dd AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY {dedup_key()} ORDER BY id) = 1)"
          if dedup else "dd AS (SELECT * FROM f)")
    return f"""{DOCS},
f AS (SELECT *, {tok_split()} AS tokens FROM docs
      WHERE length(text) >= {min_chars} AND label IS NOT NULL AND label <> ''),
{dd},
v AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY label ORDER BY {order_key('id', seed)}, id)
                     <= round_even({p}::DOUBLE * count(*) OVER (PARTITION BY label), 0)
                THEN 'train' ELSE 'job' END AS split FROM dd)"""


def source_majority_pred(v: str = "v", source: str = "source") -> str:
    """CTE ``pred(id, source, y_true, y_pred)``: per-source train mode, else global mode."""
    return f"""gmaj AS (SELECT label AS majority FROM {v} WHERE split = 'train'
                GROUP BY label ORDER BY count(*) DESC, label LIMIT 1),
smaj AS (SELECT {source} AS s, label AS lab FROM (
           SELECT {source}, label, row_number() OVER (PARTITION BY {source} ORDER BY count(*) DESC, label) AS r
           FROM {v} WHERE split = 'train' GROUP BY {source}, label) WHERE r = 1),
pred AS (SELECT j.id, j.{source} AS source, j.label AS y_true, coalesce(smaj.lab, gmaj.majority) AS y_pred
         FROM {v} j LEFT JOIN smaj ON j.{source} = smaj.s, gmaj WHERE j.split = 'job')"""


def report(pred: str = "pred", keys: tuple = ()) -> str:
    """CTEs ending in ``rep``: long classification report per ``keys``."""
    k = ", ".join(keys)
    kc = (k + ", ") if k else ""
    using = ", ".join([*keys, "label"])
    g = "GROUP BY ALL" if keys else ""
    return f"""conf AS (SELECT {kc}CAST(y_true AS VARCHAR) AS y_true, coalesce(CAST(y_pred AS VARCHAR), '__NO_PRED__') AS y_pred,
                count(*) AS cnt FROM {pred} GROUP BY ALL),
t AS (SELECT {kc}y_true AS label, sum(cnt) AS n_true FROM conf GROUP BY ALL),
p AS (SELECT {kc}y_pred AS label, sum(cnt) AS n_pred FROM conf GROUP BY ALL),
tp AS (SELECT {kc}y_true AS label, sum(cnt) AS tp FROM conf WHERE y_true = y_pred GROUP BY ALL),
per0 AS (SELECT {kc}label, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred
         FROM t FULL JOIN p USING ({using})),
per AS (SELECT per0.*, coalesce(tp.tp, 0) AS tp,
          CASE WHEN n_pred > 0 THEN coalesce(tp.tp, 0) / n_pred ELSE 0.0 END AS precision,
          CASE WHEN n_true > 0 THEN coalesce(tp.tp, 0) / n_true ELSE 0.0 END AS recall,
          CASE WHEN n_true + n_pred > 0 THEN 2.0 * coalesce(tp.tp, 0) / (n_true + n_pred) ELSE 0.0 END AS f1
        FROM per0 LEFT JOIN tp USING ({using})),
summ AS (SELECT {kc}avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf, sum(n_true) AS n, sum(tp) AS tps,
           sum(precision * n_true) AS wp, sum(recall * n_true) AS wr, sum(f1 * n_true) AS wf FROM per {g}),
rep0 AS (
  SELECT {kc}label, precision, recall, f1, n_true AS support FROM per
  UNION ALL SELECT {kc}'accuracy', coalesce(tps / nullif(n, 0), 0.0), coalesce(tps / nullif(n, 0), 0.0),
                   coalesce(tps / nullif(n, 0), 0.0), n FROM summ
  UNION ALL SELECT {kc}'macro avg', mp, mr, mf, n FROM summ
  UNION ALL SELECT {kc}'weighted avg', coalesce(wp / nullif(n, 0), 0.0), coalesce(wr / nullif(n, 0), 0.0),
                   coalesce(wf / nullif(n, 0), 0.0), n FROM summ),
rep AS (SELECT {kc}label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1,
               CAST(support AS BIGINT) AS support FROM rep0)"""


def summary(rep: str = "rep", keys: tuple = ()) -> str:
    k = ", ".join(keys)
    kc = (k + ", ") if k else ""
    g = "GROUP BY ALL" if keys else ""
    return f"""SELECT {kc}max(CASE WHEN label = 'accuracy' THEN f1 END) AS accuracy,
       max(CASE WHEN label = 'macro avg' THEN f1 END) AS macro_f1,
       max(CASE WHEN label = 'macro avg' THEN precision END) AS precision_macro,
       max(CASE WHEN label = 'macro avg' THEN recall END) AS recall_macro,
       max(CASE WHEN label = 'accuracy' THEN support END) AS n_eval
FROM {rep} {g}"""
