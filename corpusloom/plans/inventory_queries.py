"""Queries of inventory and identity, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import inventory as v
from corpusloom.sources import fixtures as x

FAMILIES = {"documents": [".md", ".txt", ".pdf", ".docx", ".html"], "code": [".py", ".json", ".yml"], "media": [".png", ".jpg"]}
PROFILES = [("src0", "inbox"), ("src0/en", "english"), ("src0/en/research", "papers"), ("src3", "inbox"), ("src3/fr/a/b", "deep"), ("src5/de", "german")]


def _both(f):
    def run(spark, sf_dir):
        now = x.files(spark, sf_dir)
        return f(now, x.files_before(now))

    return run


def _files(f):
    return lambda spark, sf_dir: f(x.files(spark, sf_dir))


def _upsert(spark, sf_dir):
    docs = x.table(spark, sf_dir, "documents")
    table = docs.where("doc_id % 3 <> 0").selectExpr("doc_id", "n_chars as size", "cast(1 as int) as first_seen", "cast(1 as int) as last_seen")
    return v.upsert_seen(table, docs.where("doc_id % 2 = 0").selectExpr("doc_id", "n_chars + 1 as size"), "doc_id", "size", 2)


def _latest(spark, sf_dir):
    return v.latest(x.file_events(spark, sf_dir), ["path"], F.desc("ts"), F.desc("event_id")).select("path", "event_id", "kind")


def _profiles(spark, sf_dir):
    return v.profile_of(x.files(spark, sf_dir), spark.createDataFrame(PROFILES, "profile_root string, profile string"), "default")


def _log(spark, sf_dir):
    return v.state_log(x.file_events(spark, sf_dir).selectExpr("path as key", "event_id as seq", "kind", "ts")).withColumnRenamed("key", "path")


def _codes(spark, sf_dir):
    docs = x.table(spark, sf_dir, "documents")
    used = x.table(spark, sf_dir, "labels").selectExpr("cast(60000 + doc_id as int) as code")
    return v.next_codes(docs.select("doc_id"), used, "code", "doc_id", 60020)


def _patch(spark, sf_dir):
    docs = x.table(spark, sf_dir, "documents").select("doc_id", "lang", "source")
    changes = docs.where("doc_id % 10 = 0").selectExpr("doc_id", "case when doc_id % 20 = 0 then 'xx' end as lang", "'moved' as source").unionByName(docs.limit(0).select("doc_id", "lang", "source"))
    return v.patch(docs, changes, "doc_id", ["lang", "source"])


QUERIES = {
    "agg01_duplicate_groups": lambda s, d: v.duplicate_groups(x.table(s, d, "documents").withColumn("hash", F.sha2("text", 256)), ["n_chars", "hash"]),
    "agg02_duplicate_items": lambda s, d: v.duplicate_groups(x.table(s, d, "documents").withColumn("hash", F.sha2(F.lower(F.trim("text")), 256)), ["hash"]),
    "agg03_facets": lambda s, d: v.facets(x.table(s, d, "documents"), ["lang", "source"]),
    "agg04_status_counts": lambda s, d: x.file_events(s, d).groupBy("kind").agg(F.count("*").alias("n")),
    "agg05_scan_histograms": _files(lambda f: v.histograms(f, ["ext", "lang", "root", "depth"])),
    "agg07_folder_summary": _files(v.folder_summary),
    "agg11_folder_fingerprint": _files(v.folder_fingerprint),
    "agg13_folder_diagnosis": _files(lambda f: v.folder_diagnosis(f, FAMILIES, 0.5)),
    "agg38_next_code": _codes,
    "join01_twins": _files(v.twins),
    "join02_inferred_events": _both(v.infer_events),
    "join03_snapshot_diff": _both(v.snapshot_diff),
    "join05_unseen": _both(lambda a, b: v.unseen(a, b).select("doc_id", "path")),
    "join06_to_sync": _both(v.to_sync),
    "join12_profile_match": _profiles,
    "join24_mirror_drift": _both(v.drift),
    "join26_copies_compared": _files(lambda f: v.copies_compared(f, "root", "name")),
    "snk01_upsert_seen": _upsert,
    "snk02_latest_by_key": _latest,
    "snk03_insert_absent": lambda s, d: v.insert_absent(x.table(s, d, "labels"), x.table(s, d, "documents").select("doc_id", "lang"), "doc_id"),
    "snk11_patch": _patch,
    "win17_state_log": _log,
    "win19_large_folder_sample": _files(lambda f: v.sample_large(f.withColumn("dir", F.col("root")), ends=3)),
}
_b = f"with {x.BEFORE_SQL}"
_f = f"with {x.FILES_SQL}"
_share = {k: f"sum(case when ext in ({', '.join(repr(e) for e in e_)}) then 1 else 0 end) / count(*) as {k}" for k, e_ in FAMILIES.items()}
SQL = {
    "agg01_duplicate_groups": "select n_chars, sha256(text) as hash, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id from documents group by 1, 2 having count(*) >= 2",
    "agg02_duplicate_items": "select sha256(lower(trim(text))) as hash, count(*) as n, min(doc_id) as first_id, max(doc_id) as last_id from documents group by 1 having count(*) >= 2",
    "agg03_facets": "select facet, string_agg(value, ',' order by value) as vals from (select distinct 'lang' as facet, lang as value from documents union select distinct 'source', source from documents) group by facet",
    "agg04_status_counts": f"with {x.FILE_EVENTS_SQL} select kind, count(*) as n from file_events group by kind",
    "agg05_scan_histograms": f"{_f} " + " union all ".join(f"select '{c}' as dimension, cast({c} as varchar) as value, count(*) as n from files group by 1, 2" for c in ("ext", "lang", "root", "depth")),
    "agg07_folder_summary": f"{_f}, e as (select root, dir, ext as top_ext, row_number() over (partition by root, dir order by count(*) desc, ext) as nth from files group by root, dir, ext), s as (select root, dir, count(*) as n, cast(sum(size) as bigint) as bytes, count(distinct ext) as n_ext, min(day) as oldest, max(day) as newest, round((count(*) - count(distinct hash)) / count(*), 6) as duplicate_share from files group by root, dir) select s.root, s.dir, n, bytes, n_ext, top_ext, oldest, newest, duplicate_share, case when n <= 10 then 'every_file' when n <= 100 then 'sampled' else 'statistics' end as strategy from s join e on s.root = e.root and s.dir = e.dir and nth = 1",
    "agg11_folder_fingerprint": f"{_f} select root, dir, count(distinct name) as n_files, substring(sha1(string_agg(distinct name, chr(10) order by name)), 1, 16) as fingerprint from files group by root, dir",
    "agg13_folder_diagnosis": f"{_f}, s as (select root, dir, {', '.join(_share.values())} from files group by root, dir), t as (select *, greatest(documents, code, media) as share from s) select root, dir, case " + " ".join(f"when {k} >= 0.5 and {k} = share then '{k}'" for k in FAMILIES) + " else 'mixed' end as family, round(share, 6) as share from t",
    "agg38_next_code": "select doc_id, cast((select greatest(coalesce(max(60000 + doc_id), 60019), 60019) from labels) + row_number() over (order by doc_id) as int) as code from documents",
    "join01_twins": f"{_f}, o as (select distinct hash, path from files) select path, (select count(*) from o p where p.hash = o.hash) - 1 as twins from o where twins > 0",
    "join02_inferred_events": f"{_b}, old as (select path, max(hash) as old_hash from before group by path), new as (select path, max(hash) as hash from files group by path), k as (select hash, bool_or(path in (select path from files)) as still from before group by hash) select new.path, case when old_hash = new.hash then 'rescanned' when old_hash is not null then 'modified' when still then 'probable_copy' when still is not null then 'probable_move' else 'created' end as event from new left join old on new.path = old.path left join k on new.hash = k.hash",
    "join03_snapshot_diff": f"{_b}, a as (select path, max(hour) as hour, max(size) as size from before group by path), b as (select path, max(hour) as hour, max(size) as size from files group by path), gone as (select path as old_path, hour, size, row_number() over (partition by hour, size order by path) as nth from a where path not in (select path from b)), new as (select path, hour, size, row_number() over (partition by hour, size order by path) as nth from b where path not in (select path from a)) select 'modified' as event, a.path, null as old_path from a join b on a.path = b.path where a.hour <> b.hour or a.size <> b.size union all select case when old_path is null then 'created' when path is null then 'deleted' else 'moved' end, coalesce(path, old_path), case when path is not null then old_path end from new full join gone on new.hour = gone.hour and new.size = gone.size and new.nth = gone.nth",
    "join05_unseen": f"{_b} select doc_id, path from files f where not exists (select 1 from before b where b.path = f.path and abs(b.hour - f.hour) <= 1e-6)",
    "join06_to_sync": f"{_b}, a as (select path, max(hour) as hour, max(size) as size from before group by path), b as (select path, max(hour) as hour, max(size) as size from files group by path) select * from (select b.path, case when a.path is null then 'new' when a.size <> b.size then 'size' when abs(a.hour - b.hour) > 0.5 then 'time' end as reason from b left join a on a.path = b.path) where reason is not null",
    "join12_profile_match": f"{_f}, p(root, profile) as (values {', '.join(map(str, PROFILES))}) select distinct path, coalesce((select profile from p where files.path = p.root or starts_with(files.path, p.root || '/') order by length(p.root) desc limit 1), 'default') as profile from files",
    "join24_mirror_drift": f"{_b}, a as (select path, max(hash) as h from files group by path), b as (select path, max(hash) as h from before group by path) select * from (select coalesce(a.path, b.path) as path, case when b.h is null then 'left_only' when a.h is null then 'right_only' when a.h <> b.h then 'diverged' end as state from a full join b on a.path = b.path) where state is not null",
    "join26_copies_compared": f"{_f} select name, count(distinct root) as copies, count(distinct hash) as contents from files group by name",
    "snk01_upsert_seen": "select coalesce(t.doc_id, b.doc_id) as doc_id, coalesce(b.n_chars + 1, t.n_chars) as size, cast(case when t.doc_id is null then 2 else 1 end as int) as first_seen, cast(case when b.doc_id is null then 1 else 2 end as int) as last_seen from (select * from documents where doc_id % 3 <> 0) t full join (select * from documents where doc_id % 2 = 0) b on t.doc_id = b.doc_id",
    "snk02_latest_by_key": f"with {x.FILE_EVENTS_SQL} select path, event_id, kind from file_events qualify row_number() over (partition by path order by ts desc, event_id desc) = 1",
    "snk03_insert_absent": "select doc_id, lang from documents where doc_id not in (select doc_id from labels)",
    "snk11_patch": "select doc_id, case when doc_id % 20 = 0 then 'xx' else lang end as lang, case when doc_id % 10 = 0 then 'moved' else source end as source from documents",
    "win17_state_log": f"with {x.FILE_EVENTS_SQL} select path, event_id as seq, lag(kind) over w as from_kind, kind, cast(sum(case when kind = 'modified' then 1 else 0 end) over (partition by path order by ts, event_id rows unbounded preceding) as bigint) as attempts from file_events window w as (partition by path order by ts, event_id)",
    "win19_large_folder_sample": f"{_f} select root, root as dir, path from files qualify row_number() over (partition by root order by name, doc_id) <= 3 or row_number() over (partition by root order by name desc, doc_id desc) <= 3 or percent_rank() over (partition by root order by size desc) <= 0.05 or regexp_matches(name, '(?i)(password|secret|final)')",
}
