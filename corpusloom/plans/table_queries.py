"""Queries that write tables or files and read them again, and those of the steps that streams run, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import inventory, records
from corpusloom.plans import folder_queries as fq
from corpusloom.plans.prediction_queries import decisions
from corpusloom.sources import fixtures as x
from corpusloom.sources import folders, tables, workspace
from corpusloom.streaming import ingest, learning, sinks

#: Folder profiles: name, path, protected, review only, threshold.
PROFILES = [("large", "src0", False, False, 0.5), ("guarded", "src2", True, False, 0.5), ("looked_at", "src3", False, True, 0.5), ("careful", "src4", False, False, 0.95), ("plain", "src1", False, False, 0.5)]
#: The events of files, by doc_id: some are dead, some are of files that aren't there.
EVENT = {
    "event_id": "doc_id", "kind": "case doc_id % 12 when 0 then 'deleted' when 1 then 'odd' when 2 then 'moved' when 3 then 'modified' else 'created' end", "is_directory": "doc_id % 13 = 0",
    "path": "case when doc_id % 19 = 0 then null when doc_id % 17 = 0 then path || '.gone' when doc_id % 12 = 2 then 'old/' || name else path end", "dest_path": "case when doc_id % 12 = 2 then path end",
}


def _events(f):
    return f.selectExpr(*(f"{e} as {c}" for c, e in EVENT.items()))


def _one_each(f):
    first = f.groupBy("path").agg(F.min("doc_id").alias("doc_id"))
    return f.join(first, ["path", "doc_id"], "left_semi")


def _ingested(s, d):
    f = x.files(s, d)
    known = s.createDataFrame(PROFILES, "name string, path string, protected boolean, review_only boolean, threshold double")
    return ingest.decided(_events(f), known, fq._bytes(_one_each(f)))


def _path_states(s, d):
    f = x.files(s, d)
    batch = _events(f).withColumn("ts", F.timestamp_seconds(1704067200 + F.col("event_id") * 60)).where("kind <> 'odd'")
    path = workspace.folder(s, "states")
    for i in range(3):  # three batches, the second delivered twice
        for _ in range(1 + (i == 1)):
            sinks.state_sink(path)(batch.where(F.col("event_id") % 3 == i), i)
    return tables.current(s, path).select("path", "kind", "moved_from", "event_id")


def _predictions(s, d):
    rows = decisions(s, d).select("doc_id", F.timestamp_seconds("doc_id").alias("ts"), "approved", F.concat_ws("|", "lang", "st").alias("key"), F.array("ct", "source").alias("tags"))
    return learning.predicted(learning.learned_batch(rows))


def _manifest(s, d):
    path = workspace.folder(s, "manifest")
    tables.manifest(x.files(s, d).select("root", "doc_id", "ext"), ["root"], path, most=7)
    again = s.read.schema("root string, part bigint, rows array<struct<doc_id: bigint, ext: string>>").json(path)
    return again.select("root", "part", F.size("rows").alias("n"), F.array_join(F.transform("rows", lambda r: F.concat(r["doc_id"].cast("string"), r["ext"])), ",").alias("members"))


def _upserted(s, d):
    f, path = x.files(s, d).select("path", "doc_id", "size"), workspace.folder(s, "keyed")
    tables.upsert(f.where("doc_id % 3 <> 0"), ["path"], path, ["doc_id"])
    return tables.upsert(f.where("doc_id % 3 = 0"), ["path"], path, ["doc_id"])


def _ledger(s, d):
    path = workspace.folder(s, "ledger")
    events = x.file_events(s, d).select("event_id", "kind", "path")
    step = sinks.ledger_sink(path)
    for i in (0, 1, 1):
        step(events.where(F.col("event_id") % 2 == i), i)
    return s.read.schema("event_id bigint, kind string, path string").json(path).groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("path").alias("paths"))


def _inventoried(s, d):
    """Texts written in folders by root and language, and listed again."""
    path = workspace.folder(s, "texts")
    x.files(s, d).select("root", F.substring_index("dir", "/", -1).alias("last"), "doc_id").select(F.col("doc_id").cast("string").alias("value"), "root", F.length("last").alias("depth")).write.partitionBy("root", "depth").text(path)
    got = folders.walk(s, [path], exts=[".txt"], content="all")
    inside = F.regexp_extract("dir", "/texts/(.*)$", 1)
    return got.where("kind = 'file'").select(inside.alias("folder"), F.explode(F.split(F.rtrim(F.regexp_replace(F.col("content").cast("string"), r"\n$", "")), "\n")).alias("line")).groupBy("folder").agg(F.count("*").alias("n"), F.sum(F.col("line").cast("bigint")).alias("total"))


def _catalog(s, d):
    """Files with bytes: their content, some cut off and some long, and a moment of change."""
    f = x.files(s, d).withColumn("bytes", F.expr("cast(case when doc_id % 7 = 0 then '' when doc_id % 50 = 1 then repeat(content, 40) else content end as binary)"))
    f = f.withColumns({"size": F.length("bytes").cast("bigint"), "modified": F.expr("date_add(date'2024-01-01', cast(day as int))")})
    return records.catalog(f, [".md", ".txt", ".html", ".py"], ["the", "and", "der"], quick=4096)


QUERIES = {
    "str08_ingest": _ingested,
    "str04_path_states": _path_states,
    "str13_predictions": _predictions,
    "snk06_manifest": _manifest,
    "snk02_upserted": _upserted,
    "snk04_ledger": _ledger,
    "src01_inventory": _inventoried,
    "flt30_catalog_records": _catalog,
    "agg07_folder_distributions": lambda s, d: inventory.folder_distributions(x.files(s, d), ["ext", "encoding"]),
}
_f = f"with {x.FILES_SQL}"
_events_sql = "events_ as (select " + ", ".join(f"{e} as {c}" for c, e in EVENT.items()) + " from files)"
_profiles = "profiles(name, root, protected, review_only, least) as (values " + ", ".join(f"('{a}', '{b}', {c}, {d}, {e})" for a, b, c, d, e in PROFILES) + ")"
SQL = {
    "str08_ingest": f"{_f}, {fq.KINDS_SQL}, {_events_sql}, {_profiles}, inv as (select * from files qualify row_number() over (partition by path order by doc_id) = 1), "
    "at_ as (select event_id, kind, is_directory, case when kind = 'moved' and dest_path is not null then dest_path else path end as path from events_), "
    "named as (select *, case when path is not null then coalesce((select name from profiles p where at_.path = p.root or starts_with(at_.path, p.root || '/')), 'default') end as profile from at_), "
    "hit as (select n.event_id, n.path, n.profile, i.hash, k.label, k.confidence, i.ext, i.dir || '/' || case when safe = '' then 'file' else safe end || '__' || k.label || '__' || i.hash[1:12] || lower(i.ext) as target from named n join (select *, regexp_replace(regexp_replace(stem, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') as safe from inv) i using (path) join kinds_of_path k on k.path = n.path where n.kind in ('created', 'modified', 'moved') and not n.is_directory), "
    "gate as (select h.*, case when p.protected then 'protected_folder' when p.review_only then 'folder_review_only' when lower(ext) in ('.exe', '.dll', '.sh', '.bat', '.cmd', '.ps1') then 'risky_file_type' when target in (select path from files) then 'target_exists' when least(0.95, confidence) < coalesce(p.least, 0.98) then 'low_confidence' else 'auto_approved_threshold' end as reason from hit h left join profiles p on p.name = h.profile), "
    "flat as (select n.event_id, n.path, n.profile, g.hash, g.label, g.confidence, g.target, g.reason as gate, n.path is null or n.kind = 'odd' as dead, n.kind = 'deleted' or n.is_directory as ignored from named n left join gate g using (event_id)) "
    "select event_id, path, profile, hash, label, confidence, target, gate <> 'auto_approved_threshold' as review, case when dead then 'not_an_event' when ignored then 'not_a_rename_candidate' when hash is null then 'file_not_found' else gate end as reason, case when dead then 'dead' when ignored then 'ignored' when hash is null then 'failed_retryable' when gate <> 'auto_approved_threshold' then 'waiting_review' else 'completed' end as status from flat".replace("kinds_of_path k on k.path = n.path", "kinds k on k.doc_id = i.doc_id"),
    "str04_path_states": f"{_f}, {_events_sql}, rows_ as (select path, case when kind = 'moved' then 'deleted' else kind end as kind, null as moved_from, event_id from events_ where kind <> 'odd' and path is not null union all select dest_path, 'created', path, event_id from events_ where kind = 'moved') select path, kind, moved_from, event_id from rows_ qualify row_number() over (partition by path order by event_id desc, moved_from is not null desc) = 1",
    "str13_predictions": "with d as (select l.doc_id, l.approved, lang || '|st' || (l.doc_id % 5) as key, 'ct' || (l.doc_id % 10) as ct, source from (select doc_id, max(quality) as approved from labels group by doc_id) l join documents using (doc_id)), u as (select doc_id, approved, 'key:' || key as unit, true as is_key from d union all select doc_id, approved, 'tag:' || ct, false from d union all select doc_id, approved, 'tag:' || source, false from d), r as (select *, count(*) over w as seen, (coalesce(sum(approved) over w, 0) + 1.0) / (count(*) over w + 2.0) as rate from u window w as (partition by unit order by doc_id rows between unbounded preceding and 1 preceding)), s as (select doc_id, max(approved) as approved, max(rate) filter (is_key) as k, max(seen) filter (is_key) as seen, avg(rate) filter (not is_key and seen > 0) as t from r group by doc_id) select doc_id, approved, round(case when t is null then k else 0.6 * k + 0.4 * t end, 4) as p, seen >= 4 as ready from s",
    "snk06_manifest": f"{_f}, n as (select root, doc_id, ext, (row_number() over (partition by root order by doc_id, ext) - 1) // 7 as part from files) select root, part, cast(count(*) as int) as n, string_agg(cast(doc_id as varchar) || ext, ',' order by doc_id) as members from n group by root, part",
    "snk02_upserted": f"{_f} select path, doc_id, size from files qualify row_number() over (partition by path order by doc_id % 3 = 0 desc, doc_id desc, size desc) = 1",
    "snk04_ledger": f"with {x.FILE_EVENTS_SQL} select kind, count(*) as n, count(distinct path) as paths from file_events group by kind",
    "src01_inventory": f"{_f} select 'root=' || root || '/depth=' || length(list_last(string_split(dir, '/'))) as folder, count(*) as n, cast(sum(doc_id) as bigint) as total from files group by 1",
    "flt30_catalog_records": f"{_f}, b as (select *, encode(case when doc_id % 7 = 0 then '' when doc_id % 50 = 1 then repeat(content, 40) else coalesce(content, '') end) as raw from files), h as (select *, lower(ext) as e, case when lower(ext) in ('.md', '.txt', '.html', '.py') then 'text' else 'blob' end as tier, hex(raw) as hx from b), "
    "t as (select *, case when tier = 'text' then lower(case when octet_length(raw) = 0 then '' else coalesce(content, '') end) else '' end as head0 from h), w as (select doc_id, unnest(regexp_extract_all(case when tier = 'text' and regexp_matches(asc_, '[a-z]{3,}') then asc_ else lower(name) end, '[a-z]{3,}')) as w from (select *, "
    "array_to_string(list_transform(regexp_extract_all(hx[1:8192], '..'), lambda p: case when p >= '61' and p <= '7A' then chr(cast(('0x' || p) as int)) when p >= '41' and p <= '5A' then chr(cast(('0x' || p) as int) + 32) else ' ' end), '') as asc_ from t)), "
    "n as (select doc_id, w, row_number() over (partition by doc_id order by count(*) desc, w) as nth from w where w not in ('the', 'and', 'der') group by doc_id, w), g as (select doc_id, string_agg(w, ', ' order by nth) as tags from n where nth <= 3 group by doc_id) "
    "select doc_id, path, name, e as ext, octet_length(raw) as size, md5(encode(cast(octet_length(raw) as varchar)) || unhex(hx[1:8192]) || case when octet_length(raw) > 8192 then unhex(hx[length(hx) - 8191:]) else ''::blob end) as md5, cast(date '2024-01-01' + cast(day as int) as date) as modified, tier, coalesce(tags, 'untagged') as tags, 'active' as status from t left join g using (doc_id)",
    "agg07_folder_distributions": f"{_f}, v as (select root, dir, unnest([{{'part': 'ext', 'value': coalesce(ext, 'none')}}, {{'part': 'encoding', 'value': coalesce(encoding, 'none')}}]) as x from files), t as (select root, dir, count(*) as total from files group by 1, 2) select root, dir, x.part as part, x.value as value, count(*) as n, round(count(*) / max(total), 6) as share from v join t using (root, dir) group by 1, 2, 3, 4",
}
