"""Queries of records, and their SQL."""

from __future__ import annotations

from corpusloom.operators import records as r
from corpusloom.plans.text_queries import SQL as TEXT_SQL
from corpusloom.plans.catalog_queries import SIDE
from corpusloom.plans.catalog_queries import SQL as CATALOG_SQL
from corpusloom.sources import fixtures as x

_t = x.table
_CLAIMS = {"doc_id": "doc_id", "primary": x.pick("doc_id % 3", ["WHAT", "HOW", "WHY"]), "noun": "doc_id % 61", "verb": "doc_id % 11", "adjective": "doc_id % 29"}
_ITEMS = {"doc_id": "doc_id", "p": "(doc_id % 101) / {h}", "cluster": "source", "risk": "(doc_id % 5) / {f}", "asked": "doc_id % 6 = 0"}
_moved = "event_id, kind as action, path || case event_id % 3 when 0 then '.PDF' when 1 then '.tar.gz' else '' end as path, case when kind = 'moved' then 'lib/' || path end as destination, ts"


def _items(s, d):
    return _t(s, d, "documents").selectExpr(*(f"{e.format(h='100.0D', f='5.0D')} as {c}" for c, e in _ITEMS.items()), "array(doc_id % 2, doc_id % 3, doc_id % 4) as answers")


QUERIES = {
    "join31_sidecar_links": lambda s, d: r.with_sidecars(x.files(s, d), SIDE).select("doc_id", "sidecar_links"),
    "txt18_doubted": lambda s, d: r.doubted(_t(s, d, "documents").selectExpr(*(f"{e} as {c}" for c, e in _CLAIMS.items()))).select("doc_id", "doubt"),
    "txt23_fingerprints": lambda s, d: r.fingerprints(_t(s, d, "documents")),
    "agg35_index_statistics": lambda s, d: r.index_statistics(_t(s, d, "documents").selectExpr("lang as classification", "doc_id % 4 as exploration_count"), _t(s, d, "conversations"), _t(s, d, "labels")),
    "str14_observed": lambda s, d: r.observed(x.file_events(s, d).selectExpr(*_moved.split(", "))).select("event_id", "file_name", "extension", "source_folder", "dest_folder", "hour", "weekday"),
    "udf08_links": lambda s, d: r.links(x.files(s, d), "content"),
    "win20_questions": lambda s, d: r.questions(_items(s, d)),
}
_f = f"with {x.FILES_SQL}"
_last = "string_split(path, '/')[-1]"
SQL = {
    "join31_sidecar_links": f"{_f}, p as ({CATALOG_SQL['join11_asset_pairs'].removeprefix(_f)}) select doc_id, sidecars as sidecar_links from files left join p using (dir, stem) where ext not in ({', '.join(f"'{e}'" for e in SIDE)})",
    "txt18_doubted": "with q as (select " + ", ".join(f"{e} as {c}" for c, e in _CLAIMS.items()) + " from documents) select doc_id, case when \"primary\" = 'WHY' and adjective < 5 and noun > 40 or \"primary\" = 'HOW' and verb < 5 and noun > 45 then 'WHAT' when \"primary\" = 'WHAT' and adjective > 20 and noun < 25 then 'WHY' end as doubt from q",
    "txt23_fingerprints": f"with t as ({TEXT_SQL['agg28_section_hashes']}), n as (select doc_id, max(hash) filter (level = 0) as root, count(*) filter (level = 1) as n_sections from t group by 1), a as ({CATALOG_SQL['win09_sparse_sentences']}), o as (select doc_id, text, lower(trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ')) as plain from documents) select doc_id, sha256(text) as sha256, case when plain <> '' then sha256(plain) end as plain_sha256, cast(strlen(text) as bigint) as size, root, n_sections, first, last from o left join n using (doc_id) left join a using (doc_id)",
    "agg35_index_statistics": "select 'pages' as statistic, count(*) as n from documents union all select 'unexplored', count(*) from documents where doc_id % 4 = 0 union all select 'explorations', count(*) from conversations union all select 'queue', count(*) from labels union all select 'class:' || lang, count(*) from documents where lang is not null group by lang",
    "str14_observed": f"with {x.FILE_EVENTS_SQL}, e as (select {_moved} from file_events) select event_id, {_last} as file_name, lower(regexp_extract({_last}, '{r.SUFFIX}', 1)) as extension, regexp_replace(path, '/?[^/]*$', '') as source_folder, regexp_replace(destination, '/?[^/]*$', '') as dest_folder, cast(hour(ts) as int) as hour, cast(isodow(ts) - 1 as int) as weekday from e",
    "udf08_links": f"{_f}, l as (select doc_id, regexp_extract_all(content, '{r.LINK}', 0) as l from files) select doc_id, cast(unnest(generate_series(0, len(l) - 1)) as int) as nth, unnest(l) as link from l where len(l) > 0",
    "win20_questions": "with i as (select " + ", ".join(f"{e.format(h='100.0::double', f='5.0::double')} as {c}" for c, e in _ITEMS.items()) + ", [doc_id % 2, doc_id % 3, doc_id % 4] as answers from documents), c as (select cluster, count(*) as n, count(*) filter (asked) as n_asked from i group by 1) select doc_id, round(1 - abs(2 * p - 1) + (len(list_distinct(answers)) - 1) / 2.0::double + n::double / (select max(n) from c) + risk + (1 - n_asked::double / n) - n_asked::double / n, 6) as score from i join c using (cluster) where not asked order by score desc, doc_id limit 100",
}
