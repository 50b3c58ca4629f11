"""Queries of scoring stages and metrics, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import briefs, catalog, reports
from corpusloom.operators import metrics as m
from corpusloom.operators import stages as g
from corpusloom.operators import text as t
from corpusloom.plans.text_queries import SQL as TEXT_SQL
from corpusloom.sources import fixtures as x

#: Frequent words of the supplied texts, so that every branch occurs: collection, term, weight, polarity, danger.
LEXICON = [
    ("articles", "the", 1.0, "positive", "low"), ("articles", "a", 0.5, "positive", "critical"), ("articles", "of the", 1.5, "positive", "medium"), ("verbs", "was", 2.0, "negative", "high"), ("verbs", "is", 1.5, "counter", "odd"), ("verbs", "it", 0.1, "positive", "low"),
    ("places", "in", 0.1, "positive", "low"), ("places", "on", 1.0, "positive", "low"), ("places", "at", 1.0, "positive", "low"), ("joins", "and", 1.0, "positive", "low"), ("joins", "of", 1.0, "positive", "low"), ("joins", "for", 1.0, "positive", "low"), ("joins", "that", 1.0, "positive", "low"),
]
SPECS = [
    ("article.score", "evidence", "article", "term", "articles"), ("article.score", "evidence", "article", "support", "joins"), ("article.score", "evidence", "article", "counter", "verbs"),
    ("verb.boundary", "verb", "verb", "term", "verbs"), ("verb.boundary", "verb", "verb", "support", "places"), ("verb.boundary", "verb", "verb", "counter", "articles"), ("verb.boundary", "verb", "verb", "counter", "joins"),
    ("place.score", "domain", "place", "term", "places"), ("place.score", "domain", "place", "term", "joins"),
]
_docs = lambda f: lambda s, d: f(x.table(s, d, "documents"))
_planted = lambda f: lambda s, d: f(x.planted(s, d))
#: Profiles of frequent words: profile, category, term.
PROFILES = [
    (p, c, w)
    for p, words in {
        "plain": {"justice": "the and of to in", "mercy": "is was it that", "cost_bearer": "pay price with", "coercion": "coerce blame dominate", "evidence": "citation figure sample data", "overclaim": "proves undeniable impossible", "positive": "good healing patience", "negative": "debt violation judgment"},
        "other": {"justice": "der die und das", "mercy": "les des la et", "cost_bearer": "cost sacrifice que", "coercion": "manipulate el los", "evidence": "source evidence model", "overclaim": "it the", "positive": "grace meaning sacred holy", "negative": "of and a in"},
        "late": {"justice": "accountability consequence judgment violation debt", "mercy": "forgiveness patience dignity healing", "cost_bearer": "the", "coercion": "they", "evidence": "table", "overclaim": "are", "positive": "is", "negative": "was"},
    }.items()
    for c, ws in words.items()
    for w in ws.split()
] + [("plain", "justice", "of the"), ("late", "mercy", "are there")]


def _profiled(s, d):
    return g.profiled(x.planted(s, d), s.createDataFrame(PROFILES, "profile string, category string, term string"))



def _scored(docs):
    spark = docs.sparkSession
    lexicon = spark.createDataFrame(LEXICON, "collection string, term string, weight double, polarity string, danger string")
    return m.measured(t.sentences(docs), lexicon, spark.createDataFrame(SPECS, "metric string, family string, object string, role string, collection string"))


def _rated_sentences(docs):
    each = t.sentences(docs).select(F.struct("doc_id", "nth").alias("doc_id"), F.col("sentence").alias("text"))
    rated = catalog.statement_kinds(each, none=catalog.NONE_CLAIM)
    return rated.select("doc_id.doc_id", "doc_id.nth", *rated.columns[1:])


def _records(s, d):
    files = x.planted(s, d).select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), "text")
    items = x.table(s, d, "benchmark").select(F.concat(F.lit("item "), F.col("item_id").cast("string")).alias("label"), F.concat("text", F.when(F.col("item_id").cast("string").rlike("[02468]$"), " It proves what is undeniable.").otherwise("")).alias("text"))
    return g.stage_records(files, items, ["domains", "justice", "evidence"])


QUERIES = {
    "txt11_variables": _planted(lambda v: g.run(v, ["variables"]).select("doc_id", "variables.*")),
    "txt11_domains": _planted(lambda v: g.run(v, ["domains"]).select("doc_id", "domains.*")),
    "txt12_justice": _planted(lambda v: g.run(v, ["justice"]).select("doc_id", "justice.*")),
    "txt13_evidence": _planted(lambda v: g.run(v, ["evidence"]).select("doc_id", "evidence.*")),
    "txt15_stages": _planted(lambda v: g.run(v, ["domains", "justice", "evidence"]).select("doc_id", "stages", F.col("domains.primary").alias("domain"), "justice.diagnosis", "evidence.risk")),
    "txt03_metrics": _docs(lambda v: _scored(v).drop("spans")),
    "txt05_metric_report": _docs(lambda v: m.report(_scored(v))),
    "srt03_metric_spans": _docs(lambda v: _scored(v).select("doc_id", "nth", "metric", F.array_join(F.transform("spans", lambda p: F.concat_ws(":", p["start"].cast("string"), p["term"])), ",").alias("spans"))),
    "agg15_claims": _planted(lambda v: g.claims(_rated_sentences(v))),
    "txt10_statement_kinds": _planted(catalog.statement_kinds),
    "txt17_sentence_claims": _planted(lambda v: briefs.sentence_claims(_rated_sentences(v))),
    "agg36_coverage_gaps": lambda s, d: reports.coverage_gaps(x.table(s, d, "documents").selectExpr("doc_id", "concat(source, lang) as category", "(doc_id % 100) / 100.0D as confidence"), g.run(x.planted(s, d), ["evidence"]).select("doc_id", "evidence.*"), 8, 0.2),
    "txt34_stage_records": lambda s, d: _records(s, d).select("label", "source_type", "stages", F.col("domains.primary").alias("domain"), "justice.diagnosis", "evidence.risk"),
    "txt34_batch_report": lambda s, d: g.batch_report(_records(s, d), {"domains": "primary", "justice": "diagnosis", "evidence": "risk"}),
    "txt16_profiles": lambda s, d: _profiled(s, d).withColumn("diagnosis", F.array_join("diagnosis", "|")),
    "txt16_compared": lambda s, d: g.compared(_profiled(s, d), ["late", "other", "plain"]),
}
_n = lambda ts: f"len(list_filter([{', '.join(repr(w) for w in ts)}], lambda w: contains(lower(text), w)))"


def _composition(terms, other):
    names = "[" + ", ".join(f"'{k}'" for k in terms) + "]"
    return f"select doc_id, case when list_sum(r) > 0 then {names}[list_position(r, list_max(r))] else '{other}' end as primary, list_transform(r, lambda v: case when list_sum(r) > 0 then round(100 * v / list_sum(r), 1) else {round(100 / len(terms), 1)} end) as shares from (select doc_id, [{', '.join(map(_n, terms.values()))}] as r from planted)"


_five = f"select *, greatest(0, least(100, least(justice, mercy) + cost - coercion)) as coherence, case when justice > 60 and mercy < 20 then 'terminal justice' when mercy > 60 and justice < 20 then 'false mercy' when justice > 40 and mercy > 40 and cost < 15 then 'no cost-bearer' when justice > 40 and mercy > 40 and cost > 30 then 'coherent' when coercion > 40 then 'coercive' else 'low signal' end as diagnosis from (select doc_id, " + ", ".join(f"cast(least(100, {k} * {_n(ts)}) as int) as {n}" for n, ts, k in (("justice", g.JUSTICE, 12), ("mercy", g.MERCY, 12), ("cost", g.COST, 14), ("coercion", g.COERCION, 16))) + " from planted)"
_evidence = f"select *, greatest(0, evidence - overclaim) as balance, case when overclaim > evidence + 20 then 'high' when overclaim > evidence then 'medium' else 'low' end as risk from (select doc_id, cast(least(100, 12 * {_n(g.EVIDENCE)}) as int) as evidence, cast(least(100, 18 * {_n(g.OVERCLAIM)}) as int) as overclaim from planted)"
_dangers = {"low": 1.0, "medium": 1.15, "high": 1.35, "critical": 1.65}
_c = lambda w: f"(length(low) - length(replace(low, '{w}', ''))) / {len(w)}" if " " in w else f"len(list_filter(ws, lambda y: y = '{w}'))"


def _one(metric: str) -> str:
    """A metric's counts, by hand from its lexicon."""
    of = lambda role: [r for s in SPECS if s[0] == metric and s[3] == role for r in LEXICON if r[0] == s[4]]
    family, name = next((s[1], s[2]) for s in SPECS if s[0] == metric)
    terms = of("term")
    seen = lambda role: " + ".join(f"cast({_c(r[1])} > 0 as int)" for r in of(role)) or "0"
    return f"select doc_id, nth, '{metric}' as metric, '{family}' as family, '{name}' as obj, words, cast({' + '.join(_c(r[1]) for r in terms)} as bigint) as hits, round(({' + '.join(f'{_c(r[1])} * {max(0.25, r[2]) * _dangers.get(r[4], 1.0)}' for r in terms)})::double, 9) as weighted, cast({seen('term')} as bigint) as terms, least(100.0::double, 14 * ({seen('support')})) as support, least(100.0::double, 16 * ({seen('counter')})) as counter from u"


_pct = lambda v: f"floor(greatest(0.0::double, least(100.0::double, {v})) * 100 + 0.5 + 1e-7) / 100"
_metrics = (
    f"s as ({TEXT_SQL['txt01_sentences']}), u as (select doc_id, nth, low, regexp_extract_all(low, '[\\p{{L}}\\p{{N}}_]+') as ws, greatest(1, len(regexp_extract_all(sentence, '[A-Za-z][A-Za-z0-9_\\-'']+|[χΧΩΣΘΛΨΦ][\\p{{L}}\\p{{N}}_]*'))) as words from (select *, lower(sentence) as low from s)), "
    f"m0 as ({' union all '.join(map(_one, dict.fromkeys(s[0] for s in SPECS)))}), m1 as (select *, 1000 * weighted / words as density from m0), m2 as (select *, {_pct('0.35::double * least(100.0::double, weighted * 12) + 0.20::double * least(100.0::double, density * 10) + 0.20::double * support + case when hits > 0 then 15.0::double else 0 end - 0.20::double * counter')} as score from m1), "
    f"m3 as (select *, {_pct('0.55::double * score + 0.25::double * least(100, terms * 20) + 0.20::double * (100 - counter)')} as confidence from m2 where hits > 0 or score >= 10), "
    "m4 as (select *, case when score >= 85 then 'dominant' when score >= 65 then 'strong' when score >= 35 then 'moderate' when score >= 10 then 'weak' else 'absent' end as qualifier from m3), "
    "m as (select doc_id, nth, metric, family, hits, round(weighted, 4) as weighted, terms, round(round(density, 9), 4) as density, support, counter, score, confidence, qualifier, case when family in ('evidence', 'domain', 'law') then support else 0.0::double end as evidence_support, case when contains(metric, 'boundary') then support else 0.0::double end as boundary_support, "
    "case when score < 10 then 'No meaningful signal detected.' else obj || ' signal is ' || qualifier || ' at sentence level.' end || case when counter > 40 then ' Counter-signal pressure is high; inspect contradiction or mixed category.' else '' end as symptom, case when counter > 60 then 'high' when score < 35 and hits > 0 then 'medium' else 'low' end as severity, "
    "case when counter > 40 then 'Split claim or add boundary language before promoting.' when score < 35 then 'Add clearer terms, evidence spans, or downgrade this label.' else 'No immediate repair required; preserve and compare to rivals.' end as repair, score >= 70 or counter >= 50 or score >= 45 and confidence < 55 as route from m4)"
)
_SENTENCES = TEXT_SQL["txt01_sentences"].replace("documents", "planted")


def _rated(rows: str, keys: str, last: float) -> str:
    """k: the shares of three kinds in rows (keys, low), by hand; last is the third share where there is none."""
    raw = {n: "2.5::double * len(list_filter([" + ", ".join(f"'{p}'" for p in ps) + "], lambda p: contains(low, p))) + len(list_intersect(ws, [" + ", ".join(f"'{w}'" for w in ts) + "]))" for n, (ps, ts) in catalog.KINDS.items()}
    none = dict(zip(raw, (33.3, 33.3, last), strict=True))
    return (
        f"k0 as (select {keys}, low, list_distinct(regexp_extract_all(low, '[\\p{{L}}\\p{{N}}_]+')) as ws from {rows}), k1 as (select {keys}, " + ", ".join(f"{v} as {n}" for n, v in raw.items()) + f" from k0), k2 as (select {keys}, "
        + ", ".join(f"case when what + how + why > 0 then round(100 * {n} / (what + how + why), 1) else {none[n]} end as {n}" for n in raw) + f" from k1), k as (select *, case when what >= how and what >= why then 'what' when how >= why then 'how' else 'why' end as primary, greatest(what, how, why) < 60 as mixed, round(list_sort([what, how, why], 'desc')[1] - list_sort([what, how, why], 'desc')[2], 1) as margin, greatest(what, how, why) < 45 as unscoped from k2)"
    )


_claimed = f"{x.PLANTED_SQL}, s as ({_SENTENCES}), l as (select doc_id, nth, lower(sentence) as low from s), {_rated('l', 'doc_id, nth', 33.4)}"
_plan_words = ", ".join(f"('{p}', '{c}', '{w}')" for p, c, w in PROFILES)
_profile_scores = {"justice": 12, "mercy": 12, "cost_bearer": 14, "coercion": 16, "evidence": 12, "overclaim": 18, "positive": 12, "negative": 12}
_profiles = (
    f"{x.PLANTED_SQL}, lex(profile, category, term) as (values {_plan_words}), d as (select doc_id, lower(text) as low, list_distinct(regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}_]+')) as ws from planted), h as (select doc_id, profile, category, sum(case when contains(term, ' ') then (length(low) - length(replace(low, term, ''))) // length(term) else cast(list_contains(ws, term) as int) end) as n from d, lex group by 1, 2, 3), "
    "f as (select doc_id, profile, " + ", ".join(f"cast(least(100, {k} * max(n) filter (category = '{c}')) as int) as {c}" for c, k in _profile_scores.items()) + " from h group by 1, 2), "
    "pr as (select *, greatest(0, least(100, least(justice, mercy) + cost_bearer - coercion)) as coherence, round(justice / greatest(1, mercy), 2) as ratio, justice - mercy as balance, round(evidence / greatest(1, overclaim), 2) as evidence_ratio, concat_ws('|', case when justice > 50 and mercy < 15 then 'terminal justice -- mercy absent' end, case when mercy > 50 and justice < 15 then 'false mercy -- justice absent' end, "
    "case when justice > 30 and mercy > 30 and cost_bearer < 10 then 'contradiction -- both demanded, no payer' end, case when justice > 30 and mercy > 30 and cost_bearer > 25 then 'resolution path present' end, case when coercion > 40 then 'coercion pressure detected' end, case when cost_bearer > 40 and mercy < 10 then 'cost language without restoration target' end, case when overclaim > evidence + 15 then 'overclaim exceeds evidence' end, case when evidence > overclaim + 20 then 'evidence-grounded' end, "
    "case when negative > positive + 20 then 'negative signal dominant' end, case when positive > negative + 20 then 'positive signal dominant' end, case when justice < 10 and mercy < 10 then 'low moral signal overall' end) as found from f), q as (select * exclude (found), case when found = '' then 'neutral -- insufficient signal to diagnose' else found end as diagnosis from pr)"
)
_both = f"{x.PLANTED_SQL}, both_ as (select 'doc/' || doc_id as label, 'file' as source_type, text from planted union all select 'item ' || item_id, 'claim', text || case when regexp_matches(cast(item_id as varchar), '[02468]$') then ' It proves what is undeniable.' else '' end from benchmark)"
_recs = f"{_both}, keyed as (select label || '#' || source_type as doc_id, text from both_), rec as (select b.label, b.source_type, 'domains,justice,evidence' as stages, d.primary as domain, diagnosis, risk from both_ b join ({_composition(g.DOMAINS, 'unknown').replace('from planted', 'from keyed')}) d on d.doc_id = b.label || '#' || b.source_type join ({_five.replace('from planted', 'from keyed')}) f on f.doc_id = d.doc_id join ({_evidence.replace('from planted', 'from keyed')}) e on e.doc_id = d.doc_id)"
SQL = {
    "txt11_variables": f"with {x.PLANTED_SQL} " + _composition(g.VARIABLES, "UC"),
    "txt11_domains": f"with {x.PLANTED_SQL} " + _composition(g.DOMAINS, "unknown"),
    "txt12_justice": f"with {x.PLANTED_SQL} " + _five,
    "txt13_evidence": f"with {x.PLANTED_SQL} " + _evidence,
    "txt15_stages": f"with {x.PLANTED_SQL} select doc_id, 'domains,justice,evidence' as stages, d.primary as domain, diagnosis, risk from ({_composition(g.DOMAINS, 'unknown')}) d join ({_five}) f using (doc_id) join ({_evidence}) e using (doc_id)",
    "txt03_metrics": f"with {_metrics} select * from m",
    "txt05_metric_report": f"with {_metrics}, q as (select *, route or counter > 50 as risky from m where nth < 300), r as (select *, row_number() over (partition by doc_id order by score desc, confidence desc, nth, metric) as place, row_number() over (partition by doc_id order by risky desc, nth, metric) as turn from q) select doc_id, count(*) as n, coalesce(string_agg(metric || '@' || nth, ',' order by place) filter (place <= 100), '') as top, bool_or(risky) or max(score) >= 70 as deep_audit, coalesce(string_agg(distinct symptom, '|' order by symptom) filter (risky and turn <= 10), '') as reasons from r group by doc_id",
    "agg15_claims": f"with {_claimed}, a as (select doc_id, count(*) as n, avg(what) as what, avg(how) as how, avg(why) as why, count(*) filter (greatest(what, how, why) < 60) as mixed from k group by rollup (doc_id)) select doc_id, n, round(100 * what / (what + how + why), 3) as what, round(100 * how / (what + how + why), 3) as how, round(100 * why / (what + how + why), 3) as why, mixed from a",
    "txt10_statement_kinds": f"with {x.PLANTED_SQL}, l as (select doc_id, lower(text) as low from planted), {_rated('l', 'doc_id', 33.3)} select * from k",
    "txt17_sentence_claims": f"with {_claimed} select doc_id, nth, k3.primary, mixed, margin as confidence, o as overreach, case o when 'high' then 'This claim may be crossing jurisdiction. A WHY claim with heavy WHAT language risks implying empirical proof of theological interpretation.' when 'medium' then 'Mixed jurisdiction detected. Consider splitting into separate WHAT/HOW/WHY subclaims.' else '' end as note from (select *, case when k.primary = 'what' and why > 25 then 'medium' when k.primary = 'why' and what > 30 then 'high' when k.primary = 'how' and why > 40 then 'medium' when k.primary = 'why' and how > 40 then 'low' else 'none' end as o from k) k3",
    "agg36_coverage_gaps": f"with {x.PLANTED_SQL}, ev as ({_evidence}), sc as (select doc_id, source || lang as category, (doc_id % 100) / 100.0 as confidence from documents) select 'low_confidence' as kind, category as unit, count(distinct doc_id) as n from sc where confidence < 0.2 and category is not null group by 2 union all select 'thin_category', category, count(distinct doc_id) from sc where category is not null group by 2 having count(distinct doc_id) < 8 union all select 'claims_without_evidence', cast(doc_id as varchar), overclaim - evidence from ev where overclaim > evidence + 20",
    "txt34_stage_records": f"with {_recs} select * from rec",
    "txt34_batch_report": f"with {_recs}, v as (select source_type, 'domains' as stage, domain as verdict from rec union all select source_type, 'justice', diagnosis from rec union all select source_type, 'evidence', risk from rec), t as (select source_type, count(*) as total from rec group by 1) select source_type, stage, verdict, count(*) as n, round(count(*) / max(total), 6) as share from v join t using (source_type) group by 1, 2, 3",
    "txt16_profiles": f"with {_profiles} select * from q",
    "txt16_compared": f"with {_profiles}, w as (select doc_id, max(coherence) filter (profile = 'late') as late_coherence, max(coherence) filter (profile = 'other') as other_coherence, max(coherence) filter (profile = 'plain') as plain_coherence from q group by doc_id) select *, case when late_coherence >= other_coherence and late_coherence >= plain_coherence then 'late' when other_coherence >= plain_coherence then 'other' else 'plain' end as best, greatest(late_coherence, other_coherence, plain_coherence) - least(late_coherence, other_coherence, plain_coherence) as spread from w",
}
