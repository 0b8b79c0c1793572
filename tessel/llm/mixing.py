"""Mixing sources to target weights by hierarchical budgeting.

Documents hang on a tree domain -> language -> source. A node's capacity is what it can give:
its leaves' tokens times ``max_epochs`` (none at weight 0). The budget goes down the
tree: at each node it is dealt to the children by weight; a child that cannot take
its share keeps its capacity, and its shortage is dealt to its siblings by weight again. A
node never receives more than its subtree can give, so a shortage
passes to an ancestor's other children only when all siblings are full. Shares are
whole tokens: what rounding down leaves goes out one token each by largest remainder,
then name.

A leaf with budget b and T tokens takes each document in floor(b / T) whole epochs, and
in the next epoch, a seeded order of its own, the prefix of documents whose running
total stays within the rest.

Distribution: the tree is aggregated per leaf before anything else. Running totals inside a leaf
come from totals of 4096 ranges of the seeded order, so a leaf that holds a third of
the rows is 4096 small windows. The children of one node are ranked in
one window: rows there are nodes, not documents.

Defined results: null text or one without words has no tokens; a leaf without tokens
is not taken; null domain, language or source is the node "(none)"; rows equal in id, text and leaf are
one document, taken together, each at its tokens; a budget beyond the capacity takes the
capacity. Extra columns are ignored (``mixed`` keeps them).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessel.llm.common import free, long_key, stored
from tessel.plans.rank import bucketed_rank

LEVELS = ("domain", "lang", "source")
NONE = "(none)"
SEED = "mix-1"
MAX_EPOCHS = 2
BUDGET_PERCENT = 75
#: Weights by level and node name; others weigh 1.
WEIGHTS = {"domain": {"web": 3, "books": 2}, "lang": {"en": 5, "de": 3, "fr": 3, "es": 2}, "source": {"src0": 2}}


def by_source(col: str = "source") -> Column:
    """A two-domain split of the sources, for tables without a domain column."""
    return F.when(F.col(col).isNull(), F.lit(None)).when(F.substring(F.md5(F.col(col)), 1, 1) < "8", "web").otherwise("books")


def word_count(col: str = "text") -> Column:
    t = F.regexp_replace(F.coalesce(F.col(col), F.lit("")), r"^[ \t\n\r]+|[ \t\n\r]+$", "")
    return F.when(t == "", 0).otherwise(F.size(F.split(t, r"[ \t\n\r]+"))).cast("bigint")


def weight_of(level: str, weights: dict) -> Column:
    """A node's weight as an expression over its name."""
    out = F.lit(1)
    for name, w in sorted(weights.get(level, {}).items()):
        out = F.when(F.col(level) == name, F.lit(int(w))).otherwise(out)
    return out.cast("bigint")


def deal(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """Deal ``budget`` among the rows of a parent by ``weight`` within ``cap``: adds ``share``.

    Children in order of cap / weight fill up first; the first that is not filled
    fixes the level for all after it."""
    w = Window.partitionBy(*parent).orderBy("ratio", name)
    before, after = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    d = children.withColumn("ratio", F.when(F.col("weight") > 0, F.col("cap").cast("double") / F.col("weight")).otherwise(F.lit(1e300)))
    d = (d.withColumn("rest", F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0)))
         .withColumn("weights", F.sum("weight").over(after)).withColumn("no", F.row_number().over(w)))
    # products in 38 digits: capacities and weights may both be large
    big = lambda c: F.col(c).cast("decimal(19,0)")
    fills = big("cap") * big("weights") <= big("weight") * big("rest")
    all_ = Window.partitionBy(*parent)
    d = d.withColumn("open_no", F.coalesce(F.min(F.when(~fills, F.col("no"))).over(all_), F.lit(1 << 62)))
    d = (d.withColumn("r", F.max(F.when(F.col("no") == F.col("open_no"), F.col("rest"))).over(all_))
         .withColumn("s", F.max(F.when(F.col("no") == F.col("open_no"), F.col("weights"))).over(all_)))
    open_ = (F.col("no") >= F.col("open_no")) & (F.col("weight") > 0)
    product = big("weight") * big("r")
    d = d.withColumn("share", F.when(F.col("no") < F.col("open_no"), F.col("cap")).when(open_, F.least(F.col("cap"), F.call_function("div", product, big("s")))).otherwise(0))
    d = d.withColumn("over", F.when(open_ & (F.col("share") < F.col("cap")), product % big("s")).otherwise(F.lit(-1).cast("decimal(19,0)")))
    d = d.withColumn("left", F.col("budget") - F.sum("share").over(all_))
    d = d.withColumn("turn", F.row_number().over(Window.partitionBy(*parent).orderBy(F.desc("over"), name)))
    return d.withColumn("share", F.col("share") + F.when((F.col("over") >= 0) & (F.col("turn") <= F.col("left")), 1).otherwise(0)).drop(
        "ratio", "rest", "weights", "no", "open_no", "r", "s", "over", "left", "turn")


def leaf_budgets(leaves: DataFrame, budget_percent: int, max_epochs: int, weights: dict) -> DataFrame:
    """``leaves`` (domain, lang, source, tokens) with each leaf's ``budget``."""
    paying = F.lit(True)
    for level in LEVELS:
        paying = paying & (weight_of(level, weights) > 0)
    tree = leaves.withColumn("cap", F.when(paying, F.col("tokens") * max_epochs).otherwise(0))
    total = leaves.agg(F.sum("tokens").alias("all"))
    caps = tree.agg(F.sum("cap").alias("caps"))
    # one row: the whole budget, at most the whole capacity
    top = total.join(caps, F.lit(True)).select(F.least(F.expr(f"(`all` * {int(budget_percent)}) div 100"), F.col("caps")).alias("budget"), F.lit(0).alias("root"))
    path: list[str] = ["root"]
    given = top
    tree = tree.withColumn("root", F.lit(0))
    for level in LEVELS:
        nodes = tree.groupBy(*path, level).agg(F.sum("cap").alias("cap")).withColumn("weight", weight_of(level, weights))
        dealt = deal(nodes.join(given, path), path, level)
        path = [*path, level]
        given = dealt.select(*path, F.col("share").alias("budget"))
    return leaves.join(given.drop("root"), list(LEVELS))


def decide(docs: DataFrame, domain: Column | None = None, budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS,
           weights: dict = WEIGHTS, seed: str = SEED) -> DataFrame:
    """Per document ``doc, h`` (its key), ``doc_id, domain, lang, source, tokens, copies``."""
    domain = by_source() if domain is None else domain
    name = lambda c: F.coalesce(c.cast("string"), F.lit(NONE))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), long_key(F.col("doc_id")).alias("doc"),
                       F.xxhash64(F.coalesce(F.col("text"), F.lit("\x00"))).alias("h"), name(domain).alias("domain"),
                       name(F.col("lang")).alias("lang"), name(F.col("source")).alias("source"), word_count().alias("one"))
    one = stored(rows.groupBy("doc", "h", *LEVELS).agg(F.first("doc_id").alias("doc_id"), F.sum("one").alias("tokens")), "mix")
    leaves = one.groupBy(*LEVELS).agg(F.sum("tokens").alias("tokens"))
    plan = stored(leaf_budgets(leaves, budget_percent, max_epochs, weights).select(
        *LEVELS, F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).alias("whole"),
        F.when(F.col("tokens") > 0, F.col("budget") % F.col("tokens")).otherwise(-1).alias("rest")), "leaves")
    keyed = one.join(plan, list(LEVELS)).withColumn("order", F.md5(F.concat_ws(":", F.lit(seed), F.col("whole"), F.coalesce(F.col("doc_id").cast("string"), F.lit(NONE)), "tokens")))
    ranked = bucketed_rank(keyed, list(LEVELS), "order", "h", rank_col="rank", n_col=None, weight_col="tokens", prefix_col="prefix")
    more = (F.col("rest") > 0) & (F.col("prefix") + F.col("tokens") <= F.col("rest"))
    return ranked.select("doc", "h", "doc_id", *LEVELS, "tokens", (F.col("whole") + F.when(more, 1).otherwise(0)).cast("bigint").alias("copies"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """``docs`` as the mix has them: a document taken in n epochs is n rows."""
    doc, h, copies, epoch, *leaf = free(docs, "doc", "h", "copies", "epoch", *(f"of_{c}" for c in LEVELS))
    chosen = stored(decide(docs, **how).where("copies > 0").select(
        F.col("doc").alias(doc), F.col("h").alias(h), *[F.col(c).alias(n) for c, n in zip(LEVELS, leaf)], F.col("copies").alias(copies)), "chosen")
    domain = how.get("domain")
    domain = by_source() if domain is None else domain
    key = [long_key(F.col("doc_id")).alias(doc), F.xxhash64(F.coalesce(F.col("text"), F.lit("\x00"))).alias(h)]
    key += [F.coalesce(c.cast("string"), F.lit(NONE)).alias(n) for n, c in zip(leaf, (domain, F.col("lang"), F.col("source")))]
    j = docs.select("*", *key).join(chosen, [doc, h, *leaf])
    return j.withColumn(epoch, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copies)))).select(*docs.columns)


def _level_sql(name: str, parent: str, over: str, keys: list[str], level: str, weight: str) -> str:
    k = ", ".join(keys)
    on = " AND ".join(f"n.{x} = g.{x}" for x in keys) or "true"
    part = f"PARTITION BY {k}" if keys else ""
    sel = ", ".join([*(f"n.{x}" for x in keys), f"n.{level}"])
    return f"""
{name}_n AS (SELECT {', '.join([*keys, level])}, sum(cap)::BIGINT AS cap, {weight} AS weight FROM tree GROUP BY {', '.join([*keys, level])}),
{name}_a AS (SELECT {sel}, n.cap, n.weight, g.budget, CASE WHEN weight > 0 THEN n.cap::DOUBLE / weight ELSE 1e300 END AS ratio FROM {name}_n n JOIN {parent} g ON {on}),
{name}_b AS (SELECT *, budget - coalesce(sum(cap) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
   sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights, row_number() OVER w AS no
   FROM {name}_a WINDOW w AS ({part} ORDER BY ratio, {level})),
{name}_c AS (SELECT *, coalesce(min(CASE WHEN NOT cap * weights <= weight * rest THEN no END) OVER ({part}), {1 << 62}) AS open_no FROM {name}_b),
{name}_d AS (SELECT *, max(CASE WHEN no = open_no THEN rest END) OVER ({part}) AS r, max(CASE WHEN no = open_no THEN weights END) OVER ({part}) AS s FROM {name}_c),
{name}_e AS (SELECT *, CASE WHEN no < open_no THEN cap WHEN weight > 0 THEN least(cap, (weight * r) // s) ELSE 0 END AS share FROM {name}_d),
{name}_f AS (SELECT *, CASE WHEN no >= open_no AND weight > 0 AND share < cap THEN (weight * r) % s ELSE -1 END AS over_ FROM {name}_e),
{name}_g AS (SELECT *, budget - sum(share) OVER ({part}) AS lft, row_number() OVER ({part} ORDER BY over_ DESC, {level}) AS turn FROM {name}_f),
{over} AS (SELECT {', '.join([*keys, level])}, share + CASE WHEN over_ >= 0 AND turn <= lft THEN 1 ELSE 0 END AS budget FROM {name}_g),"""


def _weight_sql(level: str, weights: dict) -> str:
    cases = "".join(f" WHEN '{n}' THEN {int(w)}" for n, w in sorted(weights.get(level, {}).items()))
    return f"(CASE {level}{cases} ELSE 1 END)" if cases else "1"


def sql(table: str = "documents", budget_percent: int = BUDGET_PERCENT, max_epochs: int = MAX_EPOCHS, weights: dict = WEIGHTS, seed: str = SEED) -> str:
    """DuckDB SQL for ``doc_id, domain, lang, source, tokens, copies``."""
    w = {x: _weight_sql(x, weights) for x in LEVELS}
    return f"""
WITH doc AS (SELECT doc_id, text, coalesce(lang, '{NONE}') AS lang, coalesce(source, '{NONE}') AS source,
   CASE WHEN source IS NULL THEN '{NONE}' WHEN substr(md5(source), 1, 1) < '8' THEN 'web' ELSE 'books' END AS domain,
   regexp_replace(coalesce(text, ''), '^[ \\t\\n\\r]+|[ \\t\\n\\r]+$', '', 'g') AS bare FROM {table}),
one AS (SELECT doc_id, text, domain, lang, source, sum(CASE WHEN bare = '' THEN 0 ELSE len(regexp_split_to_array(bare, '[ \\t\\n\\r]+')) END)::BIGINT AS tokens FROM doc GROUP BY ALL),
leaf AS (SELECT domain, lang, source, sum(tokens)::BIGINT AS tokens FROM one GROUP BY ALL),
tree AS (SELECT *, CASE WHEN {' AND '.join(f'{x} > 0' for x in w.values())} THEN tokens * {max_epochs} ELSE 0 END AS cap FROM leaf),
top AS (SELECT least((sum(tokens) * {budget_percent}) // 100, sum(cap)) AS budget FROM tree),
{_level_sql('l1', 'top', 'g1', [], 'domain', w['domain'])}
{_level_sql('l2', 'g1', 'g2', ['domain'], 'lang', w['lang'])}
{_level_sql('l3', 'g2', 'g3', ['domain', 'lang'], 'source', w['source'])}
plan AS (SELECT leaf.*, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS whole, CASE WHEN tokens > 0 THEN budget % tokens ELSE -1 END AS rest
   FROM leaf JOIN g3 USING (domain, lang, source)),
ranked AS (SELECT one.*, whole, rest, sum(one.tokens) OVER (PARTITION BY domain, lang, source
   ORDER BY md5(concat_ws(':', '{seed}', whole::BIGINT, coalesce(doc_id::VARCHAR, '{NONE}'), one.tokens)), doc_id, text ROWS UNBOUNDED PRECEDING) AS total
   FROM one JOIN plan USING (domain, lang, source))
SELECT doc_id, domain, lang, source, tokens, (whole + CASE WHEN rest > 0 AND total <= rest THEN 1 ELSE 0 END)::BIGINT AS copies FROM ranked
"""
