"""Queries of predictions from behaviour, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import prediction as p
from corpusloom.sources import fixtures as x

AS_OF, HOUR = "2024-02-01", 9


def decisions(spark, sf_dir):
    """Labelled documents as decisions, in the order of their ids."""
    docs = x.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    rows = x.table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("approved")).join(docs, "doc_id")
    return rows.withColumns({"ct": F.concat(F.lit("ct"), (F.col("doc_id") % 10).cast("string")), "st": F.concat(F.lit("st"), (F.col("doc_id") % 5).cast("string"))}).withColumn("steps", F.array(F.lit("<S>"), F.concat(F.lit("dom_"), "lang"), "ct", "st", F.lit("<E>")))


_obs = lambda f: lambda s, d: f(x.observations(s, d))
_dec = lambda f: lambda s, d: f(decisions(s, d))


def _states(spark, sf_dir):
    docs = x.table(spark, sf_dir, "documents")
    return docs.selectExpr("source", "doc_id", "case when doc_id % 4 = 1 then 'none' else lang end as state")


def _filled(spark, sf_dir):
    rows = _states(spark, sf_dir)
    pairs = p.transitions(rows, "state", ["source"], ["doc_id"])
    return p.fill(rows, pairs, "state", "none", ["source"], ["doc_id"], 0.3)


def _promoted(spark, sf_dir):
    best = p.destination(x.observations(spark, sf_dir), AS_OF).select("ext", "dest", F.col("vote").alias("confidence"), (F.col("ext") != ".txt").alias("confirmed"))
    return p.promoted(best, spark.createDataFrame([("*.pdf", "library", 5), ("*.iso", "images", 1)], "pattern string, dest string, hits long"))


def _resolved(spark, sf_dir):
    seen = x.observations(spark, sf_dir)
    guess = seen.join(p.destination(seen, AS_OF).select("ext", F.upper("dest").alias("guess")), "ext").select("event_id", F.concat("guess", F.lit("/")).alias("dest"), F.when(F.col("event_id") % 5 == 0, F.lower("name")).alias("name"))
    return p.resolved(guess, seen.select("event_id", F.when(F.col("event_id") % 7 != 0, F.col("dest")).alias("dest"), "name"), ["event_id"]).select("event_id", "correct")


QUERIES = {
    "win07_recent_by_key": _obs(lambda o: p.recent(o, ["ext"], 100).select("event_id", "ext", "dest")),
    "agg18_destination_votes": _obs(lambda o: p.votes(p.recent(o, ["ext"], 100), ["ext"], AS_OF)),
    "agg18_best_destination": _obs(lambda o: p.destination(o, AS_OF)),
    "agg18_temporal": _obs(lambda o: p.temporal(o, AS_OF, HOUR)),
    "agg18_affinity": _obs(lambda o: p.affinity(o, AS_OF)),
    "agg19_naming_habits": _obs(p.naming),
    "agg20_together": _obs(p.together),
    "agg21_combined_prediction": lambda s, d: p.combine(x.observations(s, d), AS_OF, HOUR, s.createDataFrame([(".zip", "archive", 7), (".zip", "attic", 2)], "ext string, dest string, hits long")),
    "agg21_companions": _obs(p.companions),
    "snk10_promoted_rules": _promoted,
    "agg23_resolved": _resolved,
    "agg24_smoothed_rates": _dec(lambda d: p.smoothed_rates(d, ["lang", "ct", "st"])),
    "agg25_markov_scores": _dec(lambda d: p.markov_scores(d, "steps")),
    "agg26_transitions": lambda s, d: p.transitions(_states(s, d), "state", ["source"], ["doc_id"]),
    "agg26_successor": lambda s, d: p.successor(p.transitions(_states(s, d), "state", ["source"], ["doc_id"])),
    "win08_filled_states": _filled,
    "agg34_prequential": _dec(lambda d: p.prequential(d, "lang", "doc_id")),
}
_o = f"with {x.OBSERVATIONS_SQL}"
_recent = lambda n, key="ext": f"(select * from observations qualify row_number() over (partition by {key} order by ts desc, event_id desc) <= {n})"
_w = f"exp(-ln(2.0) * (epoch(timestamp '{AS_OF}') - floor(epoch(ts))) / 86400 / 30)"


def _votes(rows: str, key: str) -> str:
    return f"(select {key}, dest, s / sum(s) over (partition by {key}) as vote from (select {key}, dest, sum({_w}) as s from {rows} group by {key}, dest))"


def _best(rows: str, key: str, factor: str = "1") -> str:
    return f"(select {key}, dest, vote * {factor} as vote from {rows} qualify row_number() over (partition by {key} order by round(vote, 9) desc, dest) = 1)"


_near = f"(select * from {_recent(200)} where abs(case when coalesce(hour, 0) = 0 then 12 else hour end - {HOUR}) <= 2)"
_d, _t, _a = _best(_votes(_recent(100), "ext"), "ext"), _best(_votes(_near, "ext"), "ext", "0.7"), _best(_votes(_recent(200), "ext, folder"), "ext, folder")
_comp = f"last as (select * from observations order by ts desc, event_id desc limit 500), q as (select ext, lead(ext) over w as partner, floor(epoch(lead(ts) over w)) - floor(epoch(ts)) as apart from last window w as (order by ts, event_id)), z as (select ext, partner from q where apart < 60 and ext <> partner), y as (select ext, partner, count(*) as n from (select ext, partner from z union all select partner, ext from z) group by ext, partner having count(*) >= 3), pt as (select ext, arg_max(partner, (n, partner)) as partner, max(n) as n from y group by ext), went as (select partner, arg_max(dest, (c, dest)) as dest from (select ext as partner, dest, count(*) as c from last where dest is not null group by 1, 2) group by partner), comp as (select ext, dest, least(1.0, n / 10) as vote from pt join went using (partner))"
_dec_sql = "d as (select l.doc_id, l.approved, lang, source, 'ct' || (l.doc_id % 10) as ct, 'st' || (l.doc_id % 5) as st from (select doc_id, max(quality) as approved from labels group by doc_id) l join documents using (doc_id))"
_states_sql = "r as (select source, doc_id, case when doc_id % 4 = 1 then 'none' else lang end as state from documents), t as (select state, after, count(*) as n from (select state, lead(state) over (partition by source order by doc_id) as after from r) where after is not null group by state, after), ts as (select *, n / sum(n) over (partition by state) as share from t)"
_succ = "(select state, after, share from ts qualify row_number() over (partition by state order by n desc, after) = 1)"
SQL = {
    "win07_recent_by_key": f"{_o} select event_id, ext, dest from {_recent(100)}",
    "agg18_destination_votes": f"{_o} select * from {_votes(_recent(100), 'ext')}",
    "agg18_best_destination": f"{_o} select * from {_d}",
    "agg18_temporal": f"{_o} select * from {_t}",
    "agg18_affinity": f"{_o} select * from {_a}",
    "agg19_naming_habits": f"{_o} select ext, count(*) as n, count(*) filter (contains(name, '_')) as underscores, count(*) filter (contains(name, '-')) as hyphens, count(*) filter (regexp_matches(name, '\\d{{4}}-\\d{{2}}-\\d{{2}}|\\d{{4}}_\\d{{2}}_\\d{{2}}|\\d{{8}}|\\d{{2}}-\\d{{2}}-\\d{{4}}')) as dates from {_recent(100)} group by ext",
    "agg20_together": f"{_o}, q as (select ext, lead(ext) over w as partner, floor(epoch(lead(ts) over w)) - floor(epoch(ts)) as apart from {_recent(500, 'folder')} window w as (partition by folder order by ts, event_id)), z as (select ext, partner from q where apart < 60 and ext <> partner) select ext, partner, count(*) as n from (select ext, partner from z union all select partner, ext from z) group by ext, partner",
    "agg21_combined_prediction": f"{_o}, {_comp}, pl as (select distinct ext, folder from observations), af as (select pl.ext, pl.folder, o.dest, o.ts from pl join {_recent(200)} o on pl.ext = o.ext and starts_with(pl.folder, o.folder)), e as (select ext, folder, dest, vote * 0.35 as v from pl join {_d} using (ext) union all select ext, folder, dest, vote * 0.15 from pl join {_t} using (ext) union all select ext, folder, dest, vote * 0.15 from {_best(_votes('af', 'ext, folder'), 'ext, folder')} union all select ext, folder, dest, vote * 0.10 from pl join comp using (ext)), s as (select ext, folder, dest, round(sum(v), 9) as vote from e group by ext, folder, dest), r as (select *, row_number() over (partition by ext, folder order by vote desc, dest) as nth from s), tp as (select ext, folder, max(dest) filter (nth = 1) as dest, max(vote) as vote, coalesce(string_agg(dest || '=' || printf('%.3f', vote), ',' order by nth) filter (nth between 2 and 4), '') as alternatives from r group by ext, folder), nm as (select ext, count(name) as names from {_recent(100)} group by ext) select ext, folder, case when ext = '.zip' then 'archive' else dest end as dest, case when ext = '.zip' then 1.0 else least(0.99, vote * (select least(1.0, count(*) / 100) from observations)) end as confidence, case when ext = '.zip' then 0.0 else round(case when names >= 5 then least(1.0, names / 20) else 0 end * 0.25, 6) end as naming, case when ext = '.zip' then '' else alternatives end as alternatives, ext = '.zip' as ruled from tp left join nm using (ext)",
    "agg21_companions": f"{_o}, {_comp} select * from comp",
    "snk10_promoted_rules": f"{_o} select '*' || ext as pattern, dest, 0::bigint as hits from {_d} where ext not in ('.txt', '.pdf', '.iso') union all select * from (values ('*.pdf', 'library', 5::bigint), ('*.iso', 'images', 1::bigint))",
    "agg23_resolved": f"{_o} select event_id, event_id % 7 = 0 or o.dest = b.dest as correct from observations o join {_d} b using (ext)",
    "agg24_smoothed_rates": f"with {_dec_sql} select lang, ct, st, count(*) as n, (sum(approved) + 1.0) / (count(*) + 2.0) as rate from d group by lang, ct, st",
    "agg25_markov_scores": f"with {_dec_sql}, s as (select doc_id, approved, unnest(['<S>', 'dom_' || lang, ct, st]) as a, unnest(['dom_' || lang, ct, st, '<E>']) as b from d), v as (select count(distinct a) as v from (select a from s union all select b from s)), pr as (select ln((sum(approved) + 1) / (sum(1 - approved) + 1)) as prior from d), ab as (select a, b, sum(approved) as n1, sum(1 - approved) as n0 from s group by a, b), fa as (select a, sum(approved) as t1, sum(1 - approved) as t0 from s group by a), w as (select a, b, ln((n1 + 0.5) / (t1 + 0.5 * v)) - ln((n0 + 0.5) / (t0 + 0.5 * v)) as w from ab join fa using (a), v) select doc_id, 1 / (1 + exp(-greatest(-30, least(30, sum(w) + max(prior))))) as p from s join w using (a, b), pr group by doc_id",
    "agg26_transitions": f"with {_states_sql} select * from ts",
    "agg26_successor": f"with {_states_sql} select * from {_succ}",
    "win08_filled_states": f"with recursive {_states_sql}, m as (select state, after from {_succ} where share >= 0.3), n as (select source, doc_id, state, row_number() over (partition by source order by doc_id) as i from r), f as (select source, i, state as s from n where i = 1 union all select n.source, n.i, case when n.state = 'none' then coalesce(m.after, n.state) else n.state end from f join n on n.source = f.source and n.i = f.i + 1 left join m on m.state = f.s) select f.source, n.doc_id, s as filled from f join n on n.source = f.source and n.i = f.i",
    "agg34_prequential": f"with {_dec_sql}, q as (select lang, approved, count(*) over w as seen, (coalesce(sum(approved) over w, 0) + 1.0) / (count(*) over w + 2.0) as p from d window w as (partition by lang order by doc_id rows between unbounded preceding and 1 preceding)) select lang, count(*) as n, count(*) filter ((p >= 0.5) = (approved = 1)) as correct, avg(-ln(case when approved = 1 then p else 1 - p end)) as log_loss from q where seen >= 4 group by lang",
}
