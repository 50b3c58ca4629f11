"""Queries of scan reports, claims, topics and expansions, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import briefs as b
from corpusloom.operators import conversations as c
from corpusloom.operators import text as t
from corpusloom.plans import text_queries as tq
from corpusloom.sources import fixtures as x

_scan = lambda f: lambda s, d: f(_Scan(x.files(s, d)))


class _Scan:
    """The files of the supplied tables as a scan: its near pairs, routes, renames and domain scores."""

    def __init__(self, files):
        self.files = files.withColumns({"domain": F.col("lang"), "level": F.expr("case when size > 3000 then 'hard' when size > 800 then 'middle' else 'easy' end")})
        self.near = files.where("doc_id % 13 = 1").selectExpr("root", "name as a", "concat(name, '~') as b", "0.85D + (doc_id % 15) / 100.0D as jaccard")
        self.routes = files.where("doc_id % 7 = 2").selectExpr("root", "path", "case when doc_id % 3 > 0 then concat('shelf', doc_id % 3) end as target")
        self.renames = files.where("doc_id % 17 = 3").selectExpr("root", "name", "concat('new_', name) as proposed", "doc_id % 2 = 0 as spelling")
        self.scores = files.where("doc_id % 11 = 4").selectExpr("root", "path", "explode(array(named_struct('domain', 'x', 'score', 0.5D), named_struct('domain', 'y', 'score', 0.44D + (doc_id % 4) / 50.0D))) as z").select("root", "path", "z.*")

    def statistics(self):
        return b.statistics(self.files)

    def anomalies(self):
        return b.anomalies(self.files, self.near, self.routes, self.scores)

    def suggestions(self):
        return b.suggestions(self.renames, self.routes, self.near)

    def report(self):
        return b.report(self.statistics(), self.anomalies(), self.suggestions())


def _feedback(scan):
    proposed = scan.suggestions()
    return b.feedback(proposed.select("root", "nth", (F.col("nth") % 5 + 1).alias("rating")), proposed)


def _answers(scan):
    asked = scan.files.selectExpr("doc_id as question_id", "case when doc_id % 10 = 9 then 'nowhere' else root end as root", "element_at(array('How many files?', 'any duplicates', 'What is wrong?', 'What next', 'hello'), cast(doc_id % 5 as int) + 1) as text")
    return b.answers(asked, scan.report())


def _pages(s, d):
    return b.topic_pages(tq._chunks(s, d).join(tq._topics(s, d), ["conv_id", "turn"]))


def _expanded(s, d):
    docs = x.table(s, d, "documents")
    relations = docs.selectExpr("concat('w', doc_id % 50) as word", "case doc_id % 3 when 0 then 'broader' when 1 then 'synonym' else 'narrower' end as relation", "concat('w', doc_id % 211) as term").distinct()
    return b.expanded(docs.where("doc_id % 5 = 0").selectExpr("lang as category", "concat('w', doc_id % 20) as word").distinct(), relations, 4, 12)


QUERIES = {
    "agg17_report_statistics": _scan(_Scan.statistics),
    "agg33_report_anomalies": _scan(_Scan.anomalies),
    "agg33_report_suggestions": _scan(_Scan.suggestions),
    "agg39_feedback": _scan(_feedback),
    "agg40_report": _scan(_Scan.report),
    "txt30_answers": _scan(_answers),
    "txt28_topic_pages": _pages,
    "txt26_expanded": _expanded,
}
_f = f"{x.FILES_SQL}, fl as (select *, lang as domain, case when size > 3000 then 'hard' when size > 800 then 'middle' else 'easy' end as level from files)"
_list = lambda v, most: f"(select root, string_agg(v || '=' || n, ',' order by nth) as l from (select root, {v} as v, count(*) as n, row_number() over (partition by root order by count(*) desc, {v}) as nth from fl group by 1, 2) where nth <= {most} group by root)"
_ext = "case when ext = '' then '[none]' else lower(ext) end"
_stats = f"st as (select a.root, greatest(a.n, coalesce(copies, 0)) as n, dm.l as domain, lv.l as level, ex.l as ext, coalesce(gr, 0) as groups, coalesce(copies, 0) as copies, round(100 * coalesce(copies, 0) / greatest(a.n, coalesce(copies, 0)), 1) as coverage from (select root, count(*) as n from fl group by root) a left join (select root, count(*) as gr, cast(sum(k) as bigint) as copies from (select root, hash, count(distinct path) as k from fl group by 1, 2 having count(distinct path) > 1) group by root) cp on cp.root = a.root left join {_list('domain', 8)} dm on dm.root = a.root left join {_list('level', 1000)} lv on lv.root = a.root left join {_list(_ext, 8)} ex on ex.root = a.root)"
_near = "nr as (select root, name as a, name || '~' as b, 0.85::double + (doc_id % 15) / 100.0::double as jaccard from files where doc_id % 13 = 1), rt as (select root, path, case when doc_id % 3 > 0 then 'shelf' || (doc_id % 3) end as target from files where doc_id % 7 = 2)"
_anomalies = "an as (select root, nth, kind, summary from (select *, cast(row_number() over (partition by root order by rank, place, summary) as int) as nth from (select root, 1 as rank, 'exact_duplicate' as kind, -count(*)::double as place, 'File exists in ' || count(*) || ' locations' as summary from files group by root, hash having count(*) >= 5 union all select root, 2, 'near_duplicate', -jaccard, 'Near-duplicate pair ' || a || ' and ' || b from nr where jaccard >= 0.9 union all select root, 3, 'orphan', 0, 'No routing match: ' || path from rt where target is null union all select root, 4, 'conflicting_domain', 0, 'Conflicting domains: ' || case when s >= 0.5 then case when s = 0.5 then 'x vs y' else 'y vs x' end else 'x vs y' end from (select distinct root, path, max(s) over (partition by root, path) as s, count(*) over (partition by root, path) as dup from (select root, path, 0.44::double + (doc_id % 4) / 50.0::double as s from files where doc_id % 11 = 4)) where abs(s - 0.5) <= 0.05)) where nth <= 10)"
_suggest = "sg as (select root, nth, kind, summary from (select *, cast(row_number() over (partition by root order by rank, place, summary) as int) as nth from (select root, case when doc_id % 2 = 0 then 1 else 2 end as rank, case when doc_id % 2 = 0 then 'spelling_correction' else 'rename' end as kind, 0::double as place, 'Rename ' || name || ' to new_' || name as summary from files where doc_id % 17 = 3 union all select root, 3, 'route', k, 'Route ' || path || ' to ' || target from (select *, row_number() over (partition by root, target order by path) as k from rt where target is not null) where k <= 3 union all select root, 4, 'family_consolidation', 0, 'Review ' || count(*) || ' near-duplicate pairs' from nr where jaccard >= 0.9 group by root)) where nth <= 10)"
_report = f"rp as (select st.root, st.n, st.coverage, coalesce(a, '') as anomalies, coalesce(s, '') as suggestions from st left join (select root, string_agg(summary, chr(10) order by nth) as a from an group by root) aa on aa.root = st.root left join (select root, string_agg(summary, chr(10) order by nth) as s from sg group by root) ss on ss.root = st.root)"
_whole = f"with {_f}, {_stats}, {_near}, {_anomalies}, {_suggest}, {_report}"
SQL = {
    "agg17_report_statistics": f"{_whole} select * from st",
    "agg33_report_suggestions": f"{_whole} select * from sg",
    "agg39_feedback": f"{_whole} select root, nth, kind, case when nth % 5 + 1 >= 4 then 1 else 0 end as approved from sg where nth % 5 + 1 <> 3",
    "txt28_topic_pages": f"with tp as ({tq.SQL['win02_topics']}), {tq._chunk} select conv_id, topic, md5(conv_id || ':' || topic) as page_id, count(*) as n, cast(sum(length(text)) as bigint) as n_chars, string_agg(distinct speaker, ',' order by speaker) as speakers, min(turn) as first, max(turn) as last from ch join tp using (conv_id, turn) group by conv_id, topic",
    "txt26_expanded": "with r as (select distinct 'w' || (doc_id % 50) as word, case doc_id % 3 when 0 then 'broader' when 1 then 'synonym' else 'narrower' end as relation, 'w' || (doc_id % 211) as term from documents), s as (select distinct lang as category, 'w' || (doc_id % 20) as word from documents where doc_id % 5 = 0), o as (select category, relation, term from s join r using (word)), t as (select o.category, r.relation, r.term from o join r on o.relation = 'broader' and r.relation = 'broader' and r.word = o.term), m as (select category, term from (select *, row_number() over (partition by category, relation order by length(term), term) as nth from (select * from o union select * from t)) where nth <= 4), e as (select category, word as term from s union select category, term from m), q as (select *, cast(row_number() over (partition by category order by length(term), term) as int) as nth from e) select * from q where nth <= 12",
}
SQL["agg33_report_anomalies"] = f"{_whole} select * from an"
SQL["agg40_report"] = f"{_whole} select * from rp"
SQL["txt30_answers"] = f"{_whole}, q as (select doc_id, case when doc_id % 10 = 9 then 'nowhere' else root end as root, doc_id % 5 as k from files) select doc_id as question_id, coalesce(case when k = 4 then 'Ask about files, duplicates, anomalies or suggestions' when k = 0 then n || ' files' when k = 1 then coverage || '% of files are copies' when k = 2 then string_split(anomalies, chr(10))[1] else string_split(suggestions, chr(10))[1] end, 'No report') as answer from q left join rp using (root)"
