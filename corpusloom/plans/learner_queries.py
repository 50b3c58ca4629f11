"""Queries of learners: each decision is scored by what was decided before its block; SQL has those that only count."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import folders
from corpusloom.operators import learners as m
from corpusloom.plans.prediction_queries import _dec_sql, decisions

COLUMNS, BLOCKS = ["lang", "ct", "st"], 4


def _blocks(spark, sf_dir):
    """Decisions in four blocks by a hash-free rule of their ids, as they come in order."""
    rows = decisions(spark, sf_dir)
    top = rows.agg((F.max("doc_id") + 1).alias("top"))
    rows = rows.crossJoin(F.broadcast(top)).withColumn("block", F.expr(f"cast(doc_id * {BLOCKS} div top as int)")).drop("top")
    return rows.withColumns({"key": F.concat_ws("|", "lang", "st"), "tags": F.array("ct", "source")})


def _scored(spark, sf_dir, *names):
    every = m.learners(COLUMNS)
    return m.backtest(_blocks(spark, sf_dir), {n: every[n] for n in names}, BLOCKS)


def _one(name):
    return lambda s, d: _scored(s, d, name).where(F.col("learner") == name).select("doc_id", F.round("p", 4).alias("p"))


def _blend(s, d):
    """Blended scores, and whether a name of a given confidence would go through."""
    rows = _scored(s, d, "frequency", "markov", "logistic", "boosted").where("learner = 'blend'")
    confidence = (F.col("doc_id") % 100) / 100
    return rows.select("doc_id", F.round("p", 4).alias("p"), folders.auto_approved(confidence, F.col("p")).alias("approved"))


QUERIES = {
    "udf03_logistic": _one("logistic"),
    "udf04_boosted": _one("boosted"),
    "udf05_blend": _blend,
    "agg34_backtest": lambda s, d: m.tested(_scored(s, d, "frequency", "markov", "logistic", "boosted")),
    "agg34_backtest_counts": lambda s, d: m.tested(_scored(s, d, "frequency", "markov")),
}
_rate = "(sum(approved) + 1.0::double) / (count(*) + 2.0::double)"
SQL = {
    "agg34_backtest_counts": f"with {_dec_sql}, b as (select *, lang || '|' || st as key, cast(doc_id * {BLOCKS} // (max(doc_id) over () + 1) as int) as block from d), n as (select unnest([1, 2, 3]) as at_block), known as (select n.at_block, b.* from n join b on b.block < n.at_block), asked as (select b.block as at_block, b.* from b where block > 0), "
    f"kr as (select at_block, key, {_rate} as r from known group by all), tr as (select at_block, tag, {_rate} as r from (select at_block, approved, unnest([ct, source]) as tag from known) group by at_block, tag), at_ as (select at_block, doc_id, avg(r) as t from (select at_block, doc_id, unnest([ct, source]) as tag from asked) join tr using (at_block, tag) group by 1, 2), "
    "freq as (select a.at_block, a.doc_id, a.approved, case when t is null then coalesce(r, 0.5) else 0.6 * coalesce(r, 0.5) + 0.4 * t end as p from asked a left join kr using (at_block, key) left join at_ using (at_block, doc_id)), "
    "ks as (select at_block, approved, unnest(['<S>', 'dom_' || lang, ct, st]) as a, unnest(['dom_' || lang, ct, st, '<E>']) as b from known), v as (select at_block, count(distinct w) as v from (select at_block, a as w from ks union all select at_block, b from ks) group by 1), pr as (select at_block, ln((sum(approved) + 1) / (sum(1 - approved) + 1)) as prior from known group by 1), ab as (select at_block, a, b, sum(approved) as n1, sum(1 - approved) as n0 from ks group by 1, 2, 3), fa as (select at_block, a, sum(approved) as t1, sum(1 - approved) as t0 from ks group by 1, 2), "
    "qs as (select at_block, doc_id, unnest(['<S>', 'dom_' || lang, ct, st]) as a, unnest(['dom_' || lang, ct, st, '<E>']) as b from asked), sc as (select q.at_block, doc_id, sum(ln((coalesce(n1, 0) + 0.5::double) / (coalesce(t1, 0) + 0.5::double * v)) - ln((coalesce(n0, 0) + 0.5::double) / (coalesce(t0, 0) + 0.5::double * v))) + max(prior) as w from qs q left join ab using (at_block, a, b) left join fa using (at_block, a) join v using (at_block) join pr using (at_block) group by 1, 2), "
    "mk as (select at_block, doc_id, approved, 1 / (1 + exp(-greatest(-30, least(30, w)))) as p from sc join asked using (at_block, doc_id)), bl as (select at_block, doc_id, approved, (0.5::double * f.p + 0.8::double * m.p) / 1.3 as p from freq f join mk m using (at_block, doc_id, approved)), "
    "e as (select 'frequency' as learner, * from freq union all select 'markov', * from mk union all select 'blend', * from bl) select learner, at_block as block, count(*) as n, count(*) filter ((p >= 0.5) = (approved = 1)) as correct, round(avg(-ln(case when approved = 1 then greatest(1e-6, least(1 - 1e-6, p)) else 1 - greatest(1e-6, least(1 - 1e-6, p)) end)), 6) as log_loss from e group by 1, 2",
}
