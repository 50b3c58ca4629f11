"""Queries of catalog rows, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import catalog as k
from corpusloom.operators import text as t
from corpusloom.plans.text_queries import SQL as TEXT_SQL
from corpusloom.sources import fixtures as x

PATTERNS, WEIGHTS = [("/research", "research"), ("invoice|receipt", "finance"), ("readme|config", "project"), ("/en/", "english")], {"research": 5, "finance": 4, "project": 3, "english": 1}
NODES = [("marks", ["tion", "the"]), ("french", ["eau", "oi"]), ("german", ["sch"])]
SIDE = [".chi", ".srt", ".json"]
_files = lambda f: lambda s, d: f(x.files(s, d))
_docs = lambda f: lambda s, d: f(x.table(s, d, "documents"))


def _health(s, d):
    e = x.file_events(s, d).withColumn("node", F.substring_index("path", "/", 1))
    return k.health(e.select("node", (F.col("event_id") % 40 != 0).alias("ok")), e.where("kind = 'created'").select("node"), 12)


def _tags(s, d):
    items = x.table(s, d, "documents").select("doc_id", F.array(F.concat(F.lit(" "), F.upper("lang")), "lang", F.lit(""), "source", F.when(F.col("doc_id") % 3 == 0, F.lit("Third")).otherwise(F.lit("x")), F.when(F.col("doc_id") % 5 == 0, F.lit("fifth")).otherwise(F.lit("X"))).alias("tags"))
    return k.normal_tags(items)[0].select("doc_id", F.array_join("tags", ",").alias("tags"))


def _discovered(s, d):
    now = x.files(s, d)
    return k.discovered(now, x.files_before(now).withColumn("size", F.expr("case when doc_id % 4 = 0 then size + 1 else size end")))


#: Texts of which some have headings.
HEADED = "case doc_id % 6 when 0 then '# One  ' || chr(10) || text || chr(13) || chr(10) || '### Three ' || lang when 1 then '#### Four' || chr(10) || text when 2 then chr(9) || '<H2 id=\"x\">Two <b>' || source || '</b></H2>' || chr(10) || text when 3 then '##none' || chr(10) || '## ' || repeat('long ', 40) else text end"
QUERIES = {
    "flt20_read_tier": _files(k.read_tier),
    "flt18_ranked": _files(lambda f: k.ranked(f, PATTERNS, WEIGHTS)),
    "flt28_health": _health,
    "flt34_normal_tags": _tags,
    "join04_discovered": _discovered,
    "join11_asset_pairs": _files(lambda f: k.pair_assets(f, SIDE)),
    "join19_node_matches": _docs(lambda v: k.node_matches(v, NODES)),
    "win09_sparse_sentences": _docs(lambda v: k.sparse_sentences(t.sentences(v))),
    "win09_headings": lambda s, d: k.headings(x.table(s, d, "documents").withColumn("text", F.expr(HEADED))).withColumn("headings", F.array_join("headings", "|")),
    "win18_next_items": _docs(lambda v: k.next_items(v.selectExpr("source", "doc_id", "n_chars % 7 as priority"), "source")),
}
_f = f"with {x.FILES_SQL}"
_in = lambda v: "(" + ", ".join(f"'{a}'" for a in v) + ")"
_occ = lambda ws: " + ".join(f"(length(text) - length(replace(lower(text), '{w}', ''))) // {len(w)}" for w in ws)
SQL = {
    "flt20_read_tier": f"{_f} select doc_id, case " + " ".join(f"when ext in {_in(v)} then '{n}'" for n, v in k.TIERS.items()) + " else 'metadata' end as tier from files",
    "flt18_ranked": f"{_f}, c as (select doc_id, size, case " + " ".join(f"when regexp_matches(lower(path), '{p}') then '{n}'" for p, n in PATTERNS) + " else 'other' end as classification from files) select doc_id, classification, cast(case classification " + " ".join(f"when '{n}' then {w}" for n, w in WEIGHTS.items()) + " else 0 end + case when size > 5000 then 2 when size > 500 then 1 else 0 end as int) as priority from c",
    "flt28_health": f"with {x.FILE_EVENTS_SQL}, e as (select *, string_split(path, '/')[1] as node from file_events), c as (select node, count(*) as n, count(*) filter (event_id % 40 <> 0) as good, count(*) filter (kind = 'created') as queued from e group by node) select node, case when good = 0 then 'failing' when good < n then 'degraded' when queued > 12 then 'busy' else 'ok' end as health from c",
    "flt34_normal_tags": "select doc_id, lang || ',' || source || ',' || case when doc_id % 3 = 0 then 'third' else 'x' end as tags from documents where (doc_id % 3 <> 0 and doc_id % 5 <> 0)",
    "join04_discovered": f"with {x.BEFORE_SQL}, a as (select path, max((case when doc_id % 4 = 0 then size + 1 else size end, hash)) as o from before group by path), b as (select path, max((size, hash)) as n from files group by path) select * from (select b.path, case when o is null then 'discovered' when o <> n then 'changed' end as state from b left join a on a.path = b.path) where state is not null",
    "join11_asset_pairs": f"{_f} select * from (select dir, stem, coalesce(string_agg(distinct name, ',' order by name) filter (ext not in {_in(SIDE)}), '') as primaries, coalesce(string_agg(distinct name, ',' order by name) filter (ext in {_in(SIDE)}), '') as sidecars from files group by dir, stem) where primaries <> '' and sidecars <> ''",
    "join19_node_matches": "with s as (" + " union all ".join(f"select '{n}' as node, doc_id, cast({_occ(ws)} as bigint) as score from documents" for n, ws in NODES) + "), r as (select *, cast(row_number() over (partition by node order by score desc, doc_id) as int) as nth from s where score > 0) select * from r where nth <= 30",
    "win09_sparse_sentences": f"with s as ({TEXT_SQL['txt01_sentences']}) select doc_id, cast(count(*) as int) as n, arg_min(sentence[1:100], nth) as first, arg_max(sentence[1:100], nth) as last, coalesce(string_agg(sentence[1:80], '|' order by nth) filter (nth % 20 = 19), '') as picked from s group by doc_id",
    "win09_headings": f"with t as (select doc_id, regexp_replace({HEADED}, '\\r\\n?', chr(10), 'g') as text from documents), l as (select doc_id, i, trim(ls[i], ' ' || chr(9) || chr(11) || chr(12)) as s from (select doc_id, ls, unnest(range(1, len(ls) + 1)) as i from (select doc_id, string_split(text, chr(10)) as ls from t))), h as (select doc_id, row_number() over (partition by doc_id order by i) as nth, trim(case when starts_with(s, '#') then regexp_replace(s, '^#{{1,3}}\\s+', '') else regexp_replace(s, '<[^>]+>', '', 'g') end, ' ')[1:120] as s from l where regexp_matches(s, '^#{{1,3}}\\s+\\S') or regexp_matches(s, '(?i)^<h[1-3][^>]*>.*</h[1-3]>')) select doc_id, cast(count(*) as int) as n, string_agg(s, '|' order by nth) as headings from h where nth <= 100 group by doc_id",
    "win18_next_items": "select source, arg_min(doc_id, (n_chars % 7, doc_id)) as doc_id from documents group by source",
}
