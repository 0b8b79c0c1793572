"""Registered queries: actor inventory, merge, label vote, derived maps, resolution."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessel.operators import actors as AC
from tessel.plans import sql as Q
from tessel.plans.registry import query
from tessel.sources.tables import actor_docs

# Fixed inputs: raw ideology annotations per crawl, and an existing actor table.
RAW_LABELS = [
    ("src0-en", "gauche"), ("src0-fr", "Gauche Moderee"), ("src0-de", "left"),
    ("src1-en", "droite"), ("src1-fr", "extreme_droite"),
    ("src2-en", "gauche"), ("src2-fr", "droite"),
    ("src3-en", "centre"), ("src3-es", "center"),
    ("src4-en", "exgauche"), ("src4-de", "extreme gauche"), ("src4-fr", "gauche"),
    ("src5-en", "far right"), ("src5-es", "droite_moderee"),
    ("src6-en", "unknown"), ("src7-en", "centre-left"), ("src7-fr", "  Centre_Gauche "),
    ("src8-es", ""), ("src9-en", "Far_Left"),
]
EXISTING_ACTORS = [
    ("src0_en", ["src0-en"], [], "left", "left", "gauche", None),
    ("src1_en", ["src1-en", "src1-old"], [], "right", "right", None, "droite"),
    ("src2_fr_example_org", ["src2-fr"], ["src2.fr.example.org"], "left", "far_left", "exgauche", None),
    ("src3_de_example_org", [], ["src3.de.example.org"], "right", "far_right", None, "exdroite"),
    ("gone_actor", ["gone-crawl"], ["gone.example.org"], "left", "left", "gauche", None),
    ("src4_en", ["src4-en", "src4-fr"], [], None, "center", None, None),
    ("src5_en", ["src5-en"], [], "right", "right", None, None),
]


def _sq(v):
    return "NULL" if v is None else "'" + str(v).replace("'", "''") + "'"


def _lst(xs):
    return "[" + ", ".join(_sq(x) for x in xs) + "]::VARCHAR[]"


RAW_SQL = "raw_labels(crawl, raw_label) AS (VALUES " + ", ".join(f"({_sq(a)}, {_sq(b)})" for a, b in RAW_LABELS) + ")"
ACTORS_SQL = ("actors(pos, actor_id, crawls, domains, side_binary, global_five, intra_left, intra_right) AS (VALUES "
              + ", ".join(f"({i}, {_sq(r[0])}, {_lst(r[1])}, {_lst(r[2])}, {', '.join(_sq(x) for x in r[3:])})"
                          for i, r in enumerate(EXISTING_ACTORS)) + ")")
ADOCS = f"""{Q.DOCS},
adocs AS (SELECT *, source || '-' || modality AS crawl,
                 CASE WHEN modality IN ('fr', 'de') THEN source || '.' || modality || '.example.org' END AS domain FROM docs)"""


def nk(c):  # key normaliser with accent stripping
    return rf"regexp_replace(regexp_replace(strip_accents(trim(lower(coalesce({c}, '')))), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"


def nkw(c):  # whitespace key normaliser
    return (rf"regexp_replace(regexp_replace(regexp_replace(lower(regexp_replace({c}, '^\s+|\s+$', '', 'g')), "
            rf"'[ \t\n]', '_', 'g'), '_{{2,}}', '_', 'g'), '^_+|_+$', '', 'g')")


def _in(xs):
    return "(" + ", ".join(_sq(x) for x in xs) + ")"


def classify_sql(k):
    fl, le, fr, ri, ce = (_in(AC.FAR_LEFT_RAW), _in(AC.LEFT_RAW), _in(AC.FAR_RIGHT_RAW), _in(AC.RIGHT_RAW), _in(AC.CENTER_RAW))
    return f"""CASE WHEN {k} IN {fl} THEN 'left' WHEN {k} IN {le} THEN 'left' WHEN {k} IN {fr} THEN 'right' WHEN {k} IN {ri} THEN 'right' END AS side_binary,
  CASE WHEN {k} IN {fl} THEN 'far_left' WHEN {k} IN {le} THEN 'left' WHEN {k} IN {fr} THEN 'far_right' WHEN {k} IN {ri} THEN 'right' WHEN {k} IN {ce} THEN 'center' END AS global_five,
  CASE WHEN {k} IN {fl} THEN 'exgauche' WHEN {k} IN {le} THEN 'gauche' END AS intra_left,
  CASE WHEN {k} IN {fl} OR {k} IN {le} THEN NULL WHEN {k} IN {fr} THEN 'exdroite' WHEN {k} IN {ri} THEN 'droite' END AS intra_right"""


def _raw_frame(spark):
    return spark.createDataFrame(RAW_LABELS, "crawl string, raw_label string")


@query("classify_raw_label", f"""WITH {ADOCS}, {RAW_SQL},
j AS (SELECT adocs.id, trim(r.raw_label) AS raw_label FROM adocs LEFT JOIN raw_labels r
      ON {nkw('adocs.crawl')} = {nkw('r.crawl')} AND r.raw_label IS NOT NULL AND trim(r.raw_label) <> ''),
k AS (SELECT id, raw_label, {nkw('raw_label')} AS k FROM j)
SELECT id, raw_label, {classify_sql('k')} FROM k""")
def q_classify(spark, sf):
    d = actor_docs(spark, sf)
    r = _raw_frame(spark).where(F.trim("raw_label") != "")
    r = F.broadcast(r.select(AC.norm_key_ws("crawl").alias("__ck"), F.trim("raw_label").alias("raw_label")))
    j = d.join(r, AC.norm_key_ws(d["crawl"]) == r["__ck"], "left")
    return j.select("id", "raw_label", AC.classify_raw_label(F.col("raw_label")).alias("c")).select("id", "raw_label", "c.*")


INVENTORY_SQL = f"""x AS (SELECT coalesce(CASE WHEN trim(domain) <> '' THEN trim(domain) END, CASE WHEN trim(crawl) <> '' THEN trim(crawl) END,
                       CAST(id AS VARCHAR)) AS raw,
             CASE WHEN trim(domain) <> '' THEN {nk('domain')} END AS dk, CASE WHEN trim(crawl) <> '' THEN {nk('crawl')} END AS ck
      FROM adocs WHERE length(text) >= 200),
y AS (SELECT {nk('raw')} AS key, raw, dk, ck FROM x),
per AS (SELECT key, raw, dk, ck, count(*) AS c FROM y WHERE key <> '' GROUP BY ALL),
var AS (SELECT key, raw, sum(c) AS c FROM per GROUP BY ALL),
top AS (SELECT key, string_agg(raw || '×' || CAST(c AS VARCHAR), '; ' ORDER BY r) AS variant_examples
        FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY c DESC, raw) AS r FROM var) WHERE r <= 5 GROUP BY key),
agg AS (SELECT key, CAST(sum(c) AS BIGINT) AS doc_count, array_to_string(list_sort(list_distinct(list(ck))), ';') AS crawl_ids,
               array_to_string(list_sort(list_distinct(list(dk))), ';') AS domain_ids FROM per GROUP BY key),
inv AS (SELECT agg.key AS actor_id, crawl_ids, domain_ids, doc_count, variant_examples FROM agg JOIN top USING (key))"""


def _inventory(spark, sf):
    d = actor_docs(spark, sf).where(F.length("text") >= 200)
    return AC.actor_inventory(d)


@query("actor_inventory", f"WITH {ADOCS}, {INVENTORY_SQL} SELECT * FROM inv ORDER BY doc_count DESC, actor_id")
def q_inventory(spark, sf):
    return _inventory(spark, sf).orderBy(F.desc("doc_count"), "actor_id")


@query("actor_merge", f"""WITH {ADOCS}, {INVENTORY_SQL}, {ACTORS_SQL},
found AS (SELECT actor_id, list_filter(string_split(crawl_ids, ';'), lambda x: x <> '') AS crawls,
                 list_filter(string_split(domain_ids, ';'), lambda x: x <> '') AS domains, doc_count FROM inv),
m AS (SELECT coalesce(f.actor_id, e.actor_id) AS actor_id,
        CASE WHEN f.actor_id IS NOT NULL THEN list_sort(list_distinct(list_concat(coalesce(e.crawls, []::VARCHAR[]), f.crawls))) ELSE e.crawls END AS crawls,
        CASE WHEN f.actor_id IS NOT NULL THEN list_sort(list_distinct(list_concat(coalesce(e.domains, []::VARCHAR[]), f.domains))) ELSE e.domains END AS domains,
        e.side_binary, e.global_five, e.intra_left, e.intra_right,
        CASE WHEN f.actor_id IS NOT NULL THEN f.doc_count END AS doc_count,
        f.actor_id IS NULL AS stale, f.actor_id IS NOT NULL AND e.actor_id IS NULL AS is_new
      FROM found f FULL JOIN actors e ON f.actor_id = e.actor_id)
SELECT actor_id, array_to_string(crawls, ';') AS crawls, array_to_string(domains, ';') AS domains,
       side_binary, global_five, intra_left, intra_right, doc_count, stale, is_new FROM m""")
def q_merge(spark, sf):
    inv = _inventory(spark, sf)
    found = inv.select("actor_id", F.filter(F.split("crawl_ids", ";"), lambda x: x != "").alias("crawls"),
                       F.filter(F.split("domain_ids", ";"), lambda x: x != "").alias("domains"), "doc_count")
    m = AC.merge_actors(found, AC.actors_frame(spark, EXISTING_ACTORS))
    return m.withColumn("crawls", F.array_join("crawls", ";")).withColumn("domains", F.array_join("domains", ";"))


VOTE_SQL = f"""ac AS (SELECT DISTINCT source AS actor_id, crawl FROM adocs),
lab AS (SELECT {nkw('crawl')} AS ck, trim(raw_label) AS raw_label FROM raw_labels WHERE raw_label IS NOT NULL AND trim(raw_label) <> ''),
j0 AS (SELECT ac.actor_id, ac.crawl, {nkw('lab.raw_label')} AS k FROM ac JOIN lab ON {nkw('ac.crawl')} = lab.ck),
j AS (SELECT actor_id, crawl, {classify_sql('k')} FROM j0),
lng AS (SELECT actor_id, crawl, 'side_binary' AS dim, side_binary AS val FROM j UNION ALL
        SELECT actor_id, crawl, 'global_five', global_five FROM j UNION ALL
        SELECT actor_id, crawl, 'intra_left', intra_left FROM j UNION ALL
        SELECT actor_id, crawl, 'intra_right', intra_right FROM j),
cnt AS (SELECT actor_id, dim, val, count(*) AS c, min(crawl) AS first FROM lng WHERE val IS NOT NULL GROUP BY ALL),
best AS (SELECT * FROM cnt QUALIFY row_number() OVER (PARTITION BY actor_id, dim ORDER BY c DESC, first) = 1),
sides AS (SELECT actor_id, count(*) AS n_sides FROM cnt WHERE dim = 'side_binary' GROUP BY actor_id),
piv AS (SELECT actor_id, max(CASE WHEN dim = 'side_binary' THEN val END) AS side_binary,
               max(CASE WHEN dim = 'global_five' THEN val END) AS global_five,
               max(CASE WHEN dim = 'intra_left' THEN val END) AS intra_left,
               max(CASE WHEN dim = 'intra_right' THEN val END) AS intra_right FROM best GROUP BY actor_id),
vote AS (SELECT a.actor_id,
  CASE WHEN coalesce(n_sides, 0) > 1 THEN NULL ELSE side_binary END AS side_binary,
  CASE WHEN coalesce(n_sides, 0) > 1 THEN NULL ELSE global_five END AS global_five,
  CASE WHEN coalesce(n_sides, 0) > 1 THEN NULL ELSE intra_left END AS intra_left,
  CASE WHEN coalesce(n_sides, 0) > 1 THEN NULL ELSE intra_right END AS intra_right
  FROM (SELECT DISTINCT actor_id FROM ac) a LEFT JOIN piv USING (actor_id) LEFT JOIN sides USING (actor_id))"""


def _vote(spark, sf):
    ac = actor_docs(spark, sf).select(F.col("source").alias("actor_id"), "crawl").distinct()
    return AC.label_vote(ac, _raw_frame(spark))


@query("actor_label_vote", f"WITH {ADOCS}, {RAW_SQL}, {VOTE_SQL} SELECT * FROM vote")
def q_vote(spark, sf):
    return _vote(spark, sf)


@query("derive_label_map", f"""WITH {ADOCS}, {RAW_SQL}, {VOTE_SQL},
acts AS (SELECT source AS actor_id, list_sort(list_distinct(list(crawl))) AS crawls,
                list_sort(list_distinct(list(domain))) AS domains FROM adocs GROUP BY source),
a AS (SELECT row_number() OVER (ORDER BY actor_id) AS pos, * FROM acts JOIN vote USING (actor_id)),
k AS (SELECT pos, global_five, intra_left, intra_right, unnest(list_concat(crawls, domains)) AS key FROM a),
vw AS (SELECT pos, key, 'global' AS view, global_five AS label FROM k UNION ALL
       SELECT pos, key, 'left_intra', intra_left FROM k UNION ALL SELECT pos, key, 'right_intra', intra_right FROM k)
SELECT view, key, arg_max(label, pos) AS label FROM vw WHERE label IS NOT NULL AND label <> '' GROUP BY view, key""")
def q_derive(spark, sf):
    d = actor_docs(spark, sf)
    acts = d.groupBy(F.col("source").alias("actor_id")).agg(
        F.array_sort(F.collect_set("crawl")).alias("crawls"), F.array_sort(F.collect_set("domain")).alias("domains"))
    # one row per actor: the rank over this small table gives the file order
    a = acts.join(_vote(spark, sf), "actor_id").withColumn(
        "pos", F.dense_rank().over(Window.orderBy("actor_id")).cast("bigint"))
    return AC.derive_label_maps(a).select("view", "key", "label")


def _resolution_sql(view: str, policy: str) -> str:
    nl = lambda c: Q.norm_label(c)
    if view == "binary":
        reason = "WHEN coalesce(side_binary, '') = '' THEN 'label_missing_for_view'"
        lab = "WHEN coalesce(side_binary, '') = '' THEN NULL ELSE side_binary"
    else:
        reason = ("WHEN coalesce(side_binary, '') <> 'left' THEN 'actor_not_left' "
                  "WHEN coalesce(intra_left, '') = '' THEN 'label_missing_for_view'")
        lab = "WHEN coalesce(side_binary, '') <> 'left' THEN NULL WHEN coalesce(intra_left, '') = '' THEN NULL ELSE intra_left"
    unk_reason = "'unknown_actor_kept'" if policy == "keep" else "'unknown_actor_dropped'"
    unk_label = "'unknown_actor'" if policy == "keep" else "NULL"
    return f"""WITH {ADOCS}, {ACTORS_SQL},
dx AS (SELECT pos, actor_id, unnest(domains) AS k FROM actors), cx AS (SELECT pos, actor_id, unnest(crawls) AS k FROM actors),
dm AS (SELECT {nl('k')} AS k, arg_max(actor_id, pos) AS da FROM dx WHERE {nl('k')} <> '' GROUP BY 1),
cm AS (SELECT {nl('k')} AS k, arg_max(actor_id, pos) AS ca FROM cx WHERE {nl('k')} <> '' GROUP BY 1),
a AS (SELECT id, {nl("coalesce(domain, '')")} AS dn, {nl("coalesce(crawl, '')")} AS cn FROM adocs),
r AS (SELECT a.id, coalesce(CASE WHEN a.dn <> '' THEN dm.da END, cm.ca) AS actor FROM a LEFT JOIN dm ON a.dn = dm.k LEFT JOIN cm ON a.cn = cm.k)
SELECT r.id, r.actor, CASE WHEN r.actor IS NULL THEN {unk_label} {lab} END AS label,
       CASE WHEN r.actor IS NULL THEN {unk_reason} {reason} ELSE 'ok' END AS reason
FROM r LEFT JOIN actors i ON r.actor = i.actor_id"""


def _resolution_q(view, policy):
    def fn(spark, sf):
        out = AC.resolve_actors(actor_docs(spark, sf), AC.actors_frame(spark, EXISTING_ACTORS), view, policy)
        return out.select("id", "actor", "label", "reason")
    return fn


query("actor_resolution", _resolution_sql("binary", "keep"))(_resolution_q("binary", "keep"))
query("actor_resolution_left", _resolution_sql("left_intra", "drop"))(_resolution_q("left_intra", "drop"))
