"""Queries of queues, lookups and routes, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import listing
from corpusloom.operators import queues as u
from corpusloom.sources import fixtures as x

ALIASES = {"the": "reader", "th": "writer", "an": "editor", "wh": "asker"}
_t = x.table
_docs = lambda f: lambda s, d: f(_t(s, d, "documents"))


def _messages(s, d):
    return _t(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), F.col("text").alias("body"), F.col("role").alias("folder"), F.array("role").alias("tags"), (F.col("turn") == 0).alias("pinned"))


def _reviews(s, d):
    queue = x.file_events(s, d).join(_t(s, d, "events").select("event_id", "user_id"), "event_id").selectExpr("event_id as review_id", "user_id as job_id", "kind as status", "ts")
    jobs = _t(s, d, "events").where("user_id % 4 <> 3").selectExpr("user_id as job_id", "case user_id % 3 when 0 then 'inbox' when 1 then 'archive' else 'work' end as role").distinct()
    return u.reviews(queue, jobs, "2024-02-01", 20, "deleted", "inbox")


def _blocks(docs):
    return u.blocks(docs.selectExpr("doc_id", "text as body", "lang as kind", "source as notebook", "concat('#', lang, '#x', doc_id % 3, '#') as tags", "n_chars as updated"), "tion", ["en", "fr"], tag="x1")


def _nodes(s, d):
    return _t(s, d, "supplier").selectExpr("s_suppkey as node", "s_suppkey % 7 = 0 as primary", "case s_suppkey % 5 when 0 then 'offline' when 1 then 'busy' when 2 then 'retired' else 'ready' end as status", "array(concat('cap', s_nationkey % 4), 'all') as capabilities")


def _dimension(s, d):
    messages = _t(s, d, "events").selectExpr("event_id", "concat('s', user_id % 40) as source")
    sources = _t(s, d, "supplier").where("s_suppkey % 2 = 0").selectExpr("concat('s', s_suppkey) as source", "cast(s_suppkey % 5 as int) as priority")
    return u.with_dimension(messages, sources, 3)


def _packets(s, d):
    return u.packets(_t(s, d, "benchmark").selectExpr("item_id as prompt_id", "text"), _t(s, d, "documents").selectExpr("doc_id", "text as body"))


def _prompts(s, d):
    rows = _t(s, d, "conversations").where("turn = 0").groupBy("conv_id").agg(F.min("text").alias("text"))
    return u.routed(rows.selectExpr("conv_id as prompt_id", "text", "case when conv_id % 2 = 0 then 'listener' end as persona"), ALIASES, "nobody")


def _outcomes(s, d):
    f = x.files(s, d).withColumns({"content": F.expr("case when doc_id % 9 = 0 then concat('---\\n', content) else content end"), "confidence": F.expr("(doc_id % 100) / 100.0D")})
    return u.outcomes(f, f, 0.8, ["src2"])


def _moves(s, d):
    return u.preferences(x.file_events(s, d).where("kind = 'moved'").selectExpr("event_id", "path", "case when event_id % 2 = 0 then concat(path, '_v', event_id % 3) else concat('done/', path) end as dest_path"), r"_v2$")


def _orphaned(s, d):
    files = x.files(s, d)
    deleted = files.where("doc_id % 3 = 0 and ext <> '.chi'").selectExpr("doc_id as event_id", "path")
    return u.orphaned(deleted, files.where("doc_id % 2 = 0").selectExpr("concat(path, '.chi') as path").distinct())


QUERIES = {
    "flt04_messages": lambda s, d: listing.items(_messages(s, d), folder="user", query="the", most=100).select("doc_id", "pinned"),
    "flt06_folder_search": lambda s, d: u.matching(x.dirs(x.files(s, d)), ["root", "dir", "parent", "base"], "RESEARCH").select("root", "dir"),
    "flt07_recent_files": lambda s, d: u.recent_files(x.files(s, d), "doc_", [".md", ".txt", ".pdf"]),
    "flt09_reviews": _reviews,
    "flt10_blocks": _docs(_blocks),
    "flt31_admitted_events": lambda s, d: u.admitted_events(x.files(s, d).selectExpr("doc_id as event_id", "path"), "src3", [".git", "tmp"], [".png", ".zip", ".exe"]),
    "flt32_outcomes": _outcomes,
    "flt33_nodes": lambda s, d: u.offering(_nodes(s, d), "cap1"),
    "flt35_blocks_by_id": lambda s, d: u.by_ids(_t(s, d, "documents").selectExpr("doc_id", "text as body"), _t(s, d, "labels").select("doc_id")),
    "srt07_pending": lambda s, d: u.pending(_t(s, d, "documents"), _t(s, d, "embeddings"), 200),
    "join30_messages": lambda s, d: _dimension(s, d)[0],
    "join30_sources": lambda s, d: _dimension(s, d)[1],
    "txt31_packets": _packets,
    "txt32_routes": _prompts,
    "str09_preferences": _moves,
    "str16_inspected": lambda s, d: u.inspected(x.files(s, d).selectExpr("doc_id as event_id", "case when doc_id % 3 = 0 then concat(path, '~') else path end as path"), x.files(s, d)),
    "str17_orphaned": _orphaned,
}
_f = f"with {x.FILES_SQL}"
_dim = "m as (select event_id, 's' || (user_id % 40) as source from events), so as (select 's' || s_suppkey as source, cast(s_suppkey % 5 as int) as priority from supplier where s_suppkey % 2 = 0)"
_ext = "lower(regexp_extract(string_split(path, '/')[-1], '(\\.[^.]*)$', 1))"
SQL = {
    "flt04_messages": "select conv_id * 1000 + turn as doc_id, turn = 0 as pinned from conversations where role = 'user' and contains(lower(text), 'the') order by pinned desc, doc_id desc limit 100",
    "flt06_folder_search": f"with {x.DIRS_SQL} select root, dir from dirs where contains(lower(root), 'research') or contains(lower(dir), 'research') or contains(lower(coalesce(parent, '')), 'research') or contains(lower(base), 'research')",
    "flt07_recent_files": f"{_f} select doc_id, path from files where (contains(lower(name), 'doc_') or contains(lower(dir), 'doc_') or contains(lower(ext), 'doc_')) and ext in ('.md', '.txt', '.pdf') order by hour desc, doc_id desc limit 50",
    "flt09_reviews": f"with {x.FILE_EVENTS_SQL}, j as (select distinct user_id, case user_id % 3 when 0 then 'inbox' when 1 then 'archive' else 'work' end as role from events where user_id % 4 <> 3) select event_id as review_id, e.user_id as job_id, coalesce(role, 'default') as role, kind as status from file_events f join events e using (event_id) left join j on j.user_id = e.user_id where f.ts <= timestamp '2024-02-01' - interval 20 day and kind = 'deleted' and role = 'inbox'",
    "flt10_blocks": "select doc_id, lang as kind from documents where contains(lower(text), 'tion') and lang in ('en', 'fr') and doc_id % 3 = 1 order by n_chars desc, doc_id desc limit 32",
    "flt31_admitted_events": f"{_f} select doc_id as event_id, case when starts_with(path, 'src3/') then 'own_repository' when list_has_any(string_split(path, '/'), ['.git', 'tmp']) then 'ignored_folder' when starts_with(string_split(path, '/')[-1], '.') then 'hidden' when {_ext} = '.log' then 'log' when {_ext} in ('.chi', '.srt', '.bak') then 'sidecar' when {_ext} in ('.png', '.zip', '.exe') then 'binary' end as reason from files",
    "flt32_outcomes": f"{_f}, g as (select *, min(doc_id) over (partition by hash) as first, (doc_id % 100) / 100.0 as confidence from files) select doc_id, case when doc_id % 9 = 0 then 'front_matter' when doc_id > first then 'duplicate' when root = 'src2' then 'no_rename' when confidence >= 0.8 then 'auto' when confidence >= 0.4 then 'pending' else 'kickout' end as route from g",
    "flt33_nodes": "select s_suppkey as node, s_suppkey % 7 = 0 as primary, cast(row_number() over (order by s_suppkey % 7 = 0 desc, s_suppkey) as int) as place from supplier where s_nationkey % 4 = 1 and s_suppkey % 5 not in (0, 2)",
    "flt35_blocks_by_id": "select doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')[1:40], ' ') as title, cast(length(text) as int) as n from documents where doc_id in (select doc_id from labels)",
    "srt07_pending": "select doc_id from documents where doc_id not in (select vec_id from embeddings) order by doc_id limit 200",
    "join30_messages": f"with {_dim} select event_id, source, coalesce(priority, 3) as priority from m left join so using (source)",
    "join30_sources": f"with {_dim} select source, priority from so union all select distinct source, 3 from m where source not in (select source from so)",
    "txt31_packets": "with w as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}'))) as w from documents), p as (select item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}'))) as w from benchmark), s as (select item_id, doc_id, count(*) as score from w join p using (w) group by 1, 2), r as (select *, row_number() over (partition by item_id order by score desc, doc_id) as nth from s) select item_id as prompt_id, string_agg(text[1:500], chr(10) || chr(10) order by nth) as packet from r join documents using (doc_id) where nth <= 3 group by item_id",
    "txt32_routes": "with p as (select conv_id, min(text) as text from conversations where turn = 0 group by conv_id), q as (select conv_id, lower(ltrim(text, ' ')) as t from p) select conv_id as prompt_id, case when starts_with(t, 'the') then 'reader' when starts_with(t, 'wh') then 'asker' when starts_with(t, 'th') then 'writer' when starts_with(t, 'an') then 'editor' when conv_id % 2 = 0 then 'listener' else 'nobody' end as target from q",
    "str09_preferences": f"with {x.FILE_EVENTS_SQL}, m as (select event_id, path, string_split(path, '/')[-1] || '_v' || (event_id % 3) as renamed, 'done/' || regexp_replace(path, '[^/]*$', '') as moved from file_events where kind = 'moved') select event_id, case when event_id % 2 = 0 then 'rename' else 'move' end as signal, case when event_id % 2 = 0 then renamed else moved end as value from m where not (event_id % 2 = 0 and event_id % 3 = 2)",
    "str16_inspected": f"{_f} select doc_id as event_id, p as path, case when p in (select path from files) then 'manual_inspect' else 'missing' end as kind from (select doc_id, case when doc_id % 3 = 0 then path || '~' else path end as p from files)",
    "str17_orphaned": f"{_f}, s as (select distinct path || '.chi' as sidecar, path as owner from files where doc_id % 2 = 0) select doc_id as event_id, sidecar from files join s on owner = path where doc_id % 3 = 0 and ext <> '.chi'",
}
