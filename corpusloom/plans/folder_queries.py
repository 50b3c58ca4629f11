"""Queries of folders, clusters, names and graphs, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import classify, diagnostics
from corpusloom.operators import folders as o
from corpusloom.operators import text as t
from corpusloom.plans import classify_queries as cq
from corpusloom.plans.text_queries import _gated
from corpusloom.plans.text_queries import SQL as TEXT_SQL
from corpusloom.sources import fixtures as x

STEPS = [("C05", "sort the media"), ("I04", "resolve the conflicts"), ("N01", "name the files")]
TERMS = ["tion", "the", "eau", "sch", "ing", "zzz"]
KNOWN = [".md", ".txt", ".pdf", ".docx", ".html"]
_files = lambda f: lambda s, d: f(x.files(s, d))


def _records(f):
    return f.select("root", "dir", "name", "ext", "hash", "hour", (F.col("doc_id") % 3 != 0).alias("tagged"), (F.col("doc_id") % 5 != 0).alias("routed"), (F.col("doc_id") % 11 == 0).alias("queued"))


def _scans(s, d):
    labels = x.table(s, d, "labels").join(x.table(s, d, "documents").select("doc_id", "source"), "doc_id")
    return o.score_changes(labels.groupBy(F.col("source").alias("root"), F.expr("doc_id div 200").alias("scanned_at")).agg(F.round(100 * F.avg("quality"), 3).alias("score")))


def _identities(s, d):
    f = x.files(s, d)
    now = f.groupBy(F.concat_ws(":", "root", "lang").alias("folder_id")).agg(F.min("dir").alias("dir"))
    before = x.files_before(f).groupBy(F.concat_ws(":", "root", "lang").alias("folder_id")).agg(F.max("dir").alias("dir"), F.array(F.min("lang")).alias("previous"))
    return o.identities(now, before)


def _pairs(f):
    return classify.group_scores(f, cq.WEIGHTS).select("source", "target", "margin")


def _kills(f):
    inside = x.dirs(f).where("base = '.git'").select(F.col("parent").alias("dir"))
    roots = f.where(F.lower("name").isin(o.MARKERS)).select("dir").unionByName(inside)
    return o.kills(_pairs(f), f, roots, layers=["en", "de", "fr", "es"])


def _clusters(s, d):
    v = lambda k, m: f"(doc_id * {k} % {m}) / {m - 1}.0D"
    c = x.table(s, d, "documents").selectExpr("doc_id as key", *(f"{v(k, 11)} as {n}" for n, k in (("F", 3), ("N", 5), ("E", 7), ("C", 2), ("T", 9), ("P", 4), ("Role", 8))), "case when doc_id % 3 = 0 then 1.0D else 0.0D end as H", "cast(doc_id % 101 as int) as safety", "doc_id % 4 = 0 as variants")
    # some clusters agree in all
    return c.select("key", "safety", "variants", *(F.when(F.col("key") % 6 == 0, 1.0).otherwise(F.col(k)).alias(k) for k in o.WEIGHTS))


def _nodes(s, d):
    docs = x.table(s, d, "documents")
    counts = t.term_counts(docs, [("n", w, 1.0) for w in TERMS]).select(F.col("term").alias("node"), "doc_id", F.col("n").alias("score"))
    return o.node_summaries(counts, TERMS, docs)


def _gate(s, d):
    return o.gate_report(_gated(s, d), x.table(s, d, "documents"))


def _corpus(f):
    items = f.selectExpr("doc_id", "ext", "(doc_id % 97) / 97.0D as confidence")
    return o.corpus(items.where("doc_id % 9 = 0"), items.where("doc_id % 9 <> 0"), 5, 6)


def _terms(s, d):
    return t.term_counts(x.table(s, d, "documents"), [("n", w, 1.0) for w in TERMS])


def _names(f):
    one = f.select("dir", "stem").distinct()
    return o.name_ratio(one.alias("p").join(one.alias("q"), F.expr("p.dir = q.dir and p.stem < q.stem")).select(F.col("p.stem").alias("a"), F.col("q.stem").alias("b"))).distinct()


def _bytes(f):
    """Files with bytes: some begin with a signature, some with a mark of code, some with bytes that are no text."""
    mark = "case doc_id % 60 " + " ".join(f"when {i} then X'{m}'" for i, m in MARKS) + " end"
    return f.withColumn("bytes", F.expr(f"case when doc_id % 60 in ({', '.join(str(i) for i, _ in MARKS)}) then {mark} || cast(content as binary) else cast(content as binary) end"))


def _suggested(f):
    return o.suggestions(f.join(o.file_kind(_bytes(f)).drop("reason"), "doc_id"))


def _coded(f):
    cols = ["doc_id", "case when doc_id % 7 <> 0 then upper(lang) end as domain", "case doc_id % 4 when 0 then 'Paper' when 1 then 'code' when 2 then 'odd' end as content_type", "case when doc_id % 3 = 0 then array() else array(lang, source) end as tags"]
    cols += ["case when doc_id % 5 <> 0 then date_add(date'2024-01-01', cast(day as int)) end as date", "case when doc_id % 2 = 0 then 'draft' else 'shipped' end as status", "ext", "(doc_id % 100) / 100.0D as confidence", "doc_id % 11 <> 0 as has_text", "case when doc_id % 3 = 1 then (doc_id % 41) / 40.0D end as preference"]
    return o.coded_names(f.withColumn("source", F.col("root")).selectExpr(*cols))


def _followed(s, d):
    b, docs = x.table(s, d, "benchmark"), x.table(s, d, "documents")
    index = docs.select(F.col("doc_id").alias("node"), F.substring("text", 1, 200).alias("line"))
    return o.followed(b.selectExpr("item_id as query_id", "text"), index, docs.selectExpr("doc_id as node", "doc_id + 1 as target").where("node % 2 = 0"))


#: First bytes of some files, by doc_id % 60.
MARKS = [(1, "255044462D"), (2, "504B0304"), (3, "89504E470D0A1A0A"), (4, "FFD8FF"), (5, "474946383761"), (6, "474946383961"), (7, "1F8B08"), (8, "696D706F727420"), (9, "00FE"), (10, "636F6E737420")]
QUERIES = {
    "agg09_pressures": _files(lambda f: o.pressures(_records(f)).select("root", "dir", "n", *o.PRESSURES, "dominant")),
    "agg10_folder_health": _files(lambda f: o.pressures(_records(f)).select("root", "dir", "health", "churn", "drivers")),
    "win16_score_changes": _scans,
    "join21_identities": _identities,
    "agg41_plans": lambda s, d: (lambda f: o.plans(diagnostics.scan(f, x.dirs(f), x.AS_OF, ["C05", "I04", "N01", "I07"]), STEPS))(x.files(s, d)),
    "dx2_simple_symptoms": _files(o.simple_symptoms),
    "join22_kills": lambda s, d: _kills(x.files(s, d)),
    "agg30_behaviour": lambda s, d: o.behaviour(_clusters(s, d)),
    "agg37_manifest_report": lambda s, d: o.manifest_report(o.behaviour(_clusters(s, d)), classify.resolution(x.files(s, d))),
    "agg14_node_summaries": _nodes,
    "agg06_gate_report": _gate,
    "join25_corpus": _files(_corpus),
    "flt19_file_kind": _files(lambda f: o.file_kind(_bytes(f))),
    "flt23_suggestions": _files(_suggested),
    "flt24_coded_names": _files(_coded),
    "flt25_projected": _files(lambda f: o.projected(f.withColumn("address", F.substring("hash", 1, 4)), "suffix")),
    "udf06_name_ratio": _files(_names),
    "txt24_records": _files(lambda f: o.records(f, f.where("root <> 'src1'").selectExpr("root", "concat('profile of ', root) as profile").distinct()).select("doc_id", "identity.*", "times.*", "policy.*", "provenance.*")),
    "grf01_nodes": lambda s, d: o.graph(_terms(s, d))[0],
    "grf01_edges": lambda s, d: o.graph(_terms(s, d))[1],
    "grf03_anti_edges": lambda s, d: o.anti_edges(s.createDataFrame([("sch", "zzz"), ("ing", "the"), ("eau", "zzz")], "a string, b string"), o.graph(_terms(s, d))[1]),
    "grf04_followed": _followed,
}
_f = f"with {x.FILES_SQL}"
_p = "p as (select root, dir, count(*) as n, count(*) filter (contains(name, ' ')) as rename_cleanup, count(*) - count(distinct hash) as duplicate_cleanup, count(*) filter (ext in ('.zip', '.rar', '.7z', '.tar', '.gz')) as archive_pressure, count(*) filter (doc_id % 5 = 0) as routing_pressure, count(*) filter (doc_id % 3 = 0) as metadata_fill_pressure, count(*) filter (doc_id % 11 = 0) as manual_review_pressure, max(hour) - min(hour) as spread from files group by root, dir)"
_all = ", ".join(o.PRESSURES)
_term = "h as (select distinct doc_id, term, (length(text) - length(replace(lower(text), term, ''))) // length(term) as n from documents, (select unnest([" + ", ".join(f"'{w}'" for w in TERMS) + "]) as term) where contains(lower(text), term))"
_edges = "e as (select x.term as a, y.term as b, count(*) as n, array_to_string(list_sort(list(x.doc_id))[1:3], ',') as evidence from h x join h y on x.doc_id = y.doc_id and x.term < y.term group by 1, 2)"
_comp = "c as (select doc_id as key, doc_id % 6 = 0 as whole, doc_id % 101 as safety, doc_id % 4 = 0 as variants, case when doc_id % 6 = 0 or doc_id % 3 = 0 then 1.0 else 0.0 end as H, " + ", ".join(f"case when doc_id % 6 = 0 then 1.0 else (doc_id * {k} % 11) / 10.0 end as {n}" for n, k in (("F", 3), ("N", 5), ("E", 7), ("C", 2), ("T", 9), ("P", 4), ("Role", 8))) + " from documents), cb as (select key, cast(greatest(0, least(100, round(100 * (2.0 * F + 3 * N + E + 3 * C + 5 * H + T + 2 * P + Role) / 18))) as int) as confidence, safety, variants, H, C from c), bh as (select key, confidence, case when confidence >= 90 and safety >= 90 then 'auto_execute_reversible' when confidence >= 90 and safety >= 50 then 'stage_require_batch_approval' when confidence >= 90 then 'link_logically_do_not_move' when confidence >= 50 then 'suggest_cluster_no_destructive_action' else 'quarantine_logically' end as behaviour, case when H > 0 then 'IDENTITY' when variants or C >= 0.45 then 'FAMILY' else 'PROJECT' end as kind from cb)"
_slug = lambda n: f"substring(regexp_replace(regexp_replace(lower(stem), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, {n})"
_pair = f"pr as (select source, target, margin from ({cq.SQL['join16_group_scores']}))"
_sym = lambda n: f"({TEXT_SQL[n]})"
_first = "case doc_id % 60 " + " ".join(f"when {i} then unhex('{m}')" for i, m in MARKS) + " else ''::blob end"
_suffixes = {"text": "'.txt', '.md', '.rst', '.log'", "code": "'.py', '.js', '.ts', '.html', '.css'", "data": "'.json', '.csv', '.xml', '.yaml', '.yml', '.sql'", "document": "'.pdf', '.doc', '.docx', '.rtf', '.xlsx'", "media": "'.jpg', '.jpeg', '.png', '.gif', '.mp3', '.mp4'", "archive": "'.zip', '.gz', '.tar', '.7z', '.rar'"}
_sign = "case when starts_with(h, '255044462D') then 'document:pdf' when starts_with(h, '504B0304') then 'archive:zip' when starts_with(h, '89504E470D0A1A0A') then 'media:png' when starts_with(h, 'FFD8FF') then 'media:jpeg' when starts_with(h, '474946383761') or starts_with(h, '474946383961') then 'media:gif' when starts_with(h, '1F8B') then 'archive:gzip' end"
_pairs_sql = "regexp_extract_all(h, '..')"
_marks_code = " or ".join(f"contains(h, hex('{m}'))" for m in ("#!/usr/bin/env", "#!/bin/", "import ", "def ", "function ", "const ", "class "))
KINDS_SQL = (
    f"heads as (select doc_id, lower(ext) as e, substr(hex({_first} || encode(coalesce(content, ''))), 1, 8192) as h from files), signs as (select *, {_sign} as sign, case " + " ".join(f"when e in ({v}) then '{k}'" for k, v in _suffixes.items()) + f" end as by_suffix, not list_contains({_pairs_sql}, '00') and len(list_filter({_pairs_sql}, lambda b: b in ('0A', '0D', '09') or b >= '20' and b <= '7E')) / greatest(len(h) / 2, 1) > 0.85 as textual from heads), "
    f"kinds as (select doc_id, case when sign is not null then split_part(sign, ':', 1) when by_suffix is not null then by_suffix when textual then case when {_marks_code} then 'code' else 'text' end else 'unknown' end as label, case when sign is not null then 0.99 when by_suffix is not null then 0.9 when textual then 0.75 else 0.4 end as confidence, case when sign is not null then split_part(sign, ':', 2) || '_signature' when by_suffix is not null then 'suffix' when textual then 'text_signature' else 'no_deterministic_match' end as reason from signs)"
)
SQL = {
    "agg09_pressures": f"{_f}, {_p} select root, dir, n, {_all}, {'[' + ', '.join(repr(a) for a in o.PRESSURES) + ']'}[list_position([{_all}], greatest({_all}))] as dominant from p",
    "agg10_folder_health": f"{_f}, {_p} select root, dir, round(1 - least(0.7, (duplicate_cleanup + manual_review_pressure) / n), 3) as health, case when n < 2 then 0 else round(spread / n, 3) end as churn, array_to_string(list_filter([case when duplicate_cleanup > 0 then 'duplicates' end, case when manual_review_pressure > 0 then 'manual_review_queue' end, case when metadata_fill_pressure > 0 then 'missing_metadata' end], lambda v: v is not null), ',') as drivers from p",
    "win16_score_changes": "with s as (select source as root, doc_id // 200 as scanned_at, round(100 * avg(quality), 3) as score from labels join documents using (doc_id) group by 1, 2) select *, score - lag(score) over (partition by root order by scanned_at) as change from s",
    "join21_identities": f"with {x.BEFORE_SQL}, n as (select root || ':' || lang as folder_id, min(dir) as dir from files group by 1), b as (select root || ':' || lang as folder_id, max(dir) as old, min(lang) as prev from before group by 1), j as (select *, coalesce(lower(old) <> lower(dir), false) as moved from n left join b using (folder_id)) select folder_id, dir, moved, coalesce(case when moved then prev || ',' || old else prev end, '') as previous from j",
    "dx2_simple_symptoms": f"{_f}, v as (select root, dir, max(n) as versions from (select root, dir, lower(regexp_replace(stem, '(?i)[_\\-\\s]*(v\\d+|final|copy|\\(\\d+\\))$', '')) as s, count(*) as n from files group by 1, 2, 3) group by 1, 2), g as (select root, dir, count(*) as n, count(distinct ext) as exts, count(distinct hash) as hashes, count(*) filter (ext in ('.jpg', '.jpeg', '.png', '.gif', '.mp4', '.mov', '.mp3', '.wav')) / count(*) as media, count(*) filter (ext in ('.md', '.txt', '.pdf', '.doc', '.docx', '.html')) / count(*) as docs from files group by 1, 2), r as (select root, dir, array_to_string(list_filter([case when exts >= 6 then 'S01' end, case when n >= 200 then 'S04' end, case when versions >= 3 then 'S02' end, case when hashes < n then 'C01' end, case when n >= 10 and media >= 0.7 then 'C05' end, case when n >= 25 and docs >= 0.6 then 'C04' end], lambda q: q is not null), ',') as symptoms from g join v using (root, dir)) select * from r where symptoms <> ''",
    "join22_kills": f"with {_pair}, {x.DIRS_SQL}, roots as (select dir from files where lower(name) in ('.git', 'package.json', 'requirements.txt', 'pyproject.toml', 'cargo.toml') union select parent from dirs where base = '.git'), fl as (select dir, bool_or(regexp_matches(lower(dir || '/' || name), 'staging|draft|work|temp|tmp|old|backup|bak')) as passing, array_to_string(list_sort(list_intersect(string_split(lower(dir), '/'), ['en', 'de', 'fr', 'es'])), ',') as level, dir in (select dir from roots where dir is not null) as program from files group by dir), a as (select dir, lower(name) as low, min(hash) as h0, max(hash) as h1, max(hour) as hour from files group by 1, 2), q as (select source, target, count(*) as same, bool_or(least(s.h0, d.h0) <> greatest(s.h1, d.h1)) as clash, bool_or(d.hour > s.hour and (s.h0 <> d.h0 or s.h1 <> d.h1)) as newer from pr join a s on s.dir = source join a d on d.dir = target and d.low = s.low group by 1, 2), fm as (select source, target, max(k) > 1 as forms from (select source, target, lower(stem), count(distinct lower(ext)) as k from pr join files on dir in (source, target) group by 1, 2, 3) group by 1, 2), n as (select dir, count(*) as n, bool_or(h0 <> h1) as own from a group by dir) select source, target, array_to_string(list_filter([case when coalesce(forms, false) then 'format_variants_detected' end, case when coalesce(same, 0) = sn.n then 'incoming_folder_subset_of_target' end, case when margin < 0.12 then 'multiple_targets_low_rival_margin' end, case when sf.program or tf.program then 'protected_program_root_detected' end, case when sf.passing then 'provenance_penalty_path_signal' end, case when sf.level <> '' and tf.level <> '' and sf.level <> tf.level then 'reading_layer_conflict' end, case when coalesce(clash, false) or sn.own or tn.own then 'same_filename_different_hash' end, case when coalesce(newer, false) then 'target_newer_than_incoming' end], lambda v: v is not null), ',') as kills from pr left join q using (source, target) left join fm using (source, target) left join n sn on sn.dir = source left join n tn on tn.dir = target left join fl sf on sf.dir = source left join fl tf on tf.dir = target",
    "agg30_behaviour": f"with {_comp} select * from bh",
    "agg37_manifest_report": f"with {_comp} select 'behaviour' as part, behaviour as value, count(*) as n from bh group by 2 union all select 'state', state, count(*) from ({cq.SQL['join23_resolution']}) group by 2",
    "agg14_node_summaries": f"with {_term}, r as (select term, doc_id, row_number() over (partition by term order by n desc, doc_id) as nth from h), w as (select unnest([{', '.join(repr(w) for w in TERMS)}]) as node) select node, count(doc_id) as n, round(count(doc_id) / (select count(*) from documents), 6) as share, coalesce(string_agg(cast(doc_id as varchar), ',' order by nth) filter (nth <= 30), '') as top from w left join r on term = node group by node",
    "agg06_gate_report": f"select category, overridden, count(*) as n, string_agg(distinct source, ',' order by source) as sources from {_sym('txt08_gate')} join documents using (doc_id) group by 1, 2",
    "join25_corpus": f"{_f}, i as (select doc_id, ext, (doc_id % 97) / 97.0 as confidence from files), a as (select * from i where doc_id % 9 = 0), u as (select *, 'approved' as origin from a union all select *, 'reference' from i where doc_id % 9 <> 0 and ext not in (select ext from a group by ext having count(*) >= 5)) select ext, doc_id, origin from u qualify row_number() over (partition by ext order by origin, confidence desc, doc_id) <= 6",
    "flt19_file_kind": f"{_f}, {KINDS_SQL} select doc_id, label, confidence, reason from kinds",
    "flt23_suggestions": f"{_f}, {KINDS_SQL} select doc_id, dir || '/' || case when safe = '' then 'file' else safe end || '__' || label || '__' || hash[1:12] || lower(ext) as target, least(0.95, confidence) as confidence from (select *, regexp_replace(regexp_replace(stem, '[^A-Za-z0-9._-]+', '_', 'g'), '^[._-]+|[._-]+$', '', 'g') as safe from files join kinds using (doc_id))",
    "flt24_coded_names": f"{_f}, c as (select doc_id, lower(ext) as e, (doc_id % 100) / 100.0 as conf, doc_id % 11 <> 0 as text, case when doc_id % 3 = 1 then (doc_id % 41) / 40.0 end as pref, lower(ext) in ('.py', '.js', '.ts', '.ahk', '.json', '.csv', '.sqlite', '.db', '.md', '.txt', '.png', '.jpg', '.jpeg', '.gif', '.webp', '.svg', '.mp4', '.mov', '.avi', '.mkv', '.mp3', '.wav', '.flac') as certain, case when doc_id % 7 <> 0 then upper(lang) else 'GN' end || '__' || case doc_id % 4 when 0 then 'PAP' when 1 then 'COD' else 'DOC' end || '__' || case when doc_id % 3 = 0 then 'GN' else lang || '-' || root end || '__' || case when doc_id % 5 <> 0 then strftime(date '2024-01-01' + cast(day as int), '%Y%m%d') else '00000000' end || '__' || case when doc_id % 2 = 0 then 'DR' else 'AC' end || lower(ext) as coded from files) select doc_id, case when not (conf < 0.45 and not certain and not text) then coded[1:180] end as coded, case when conf < 0.45 and not certain and not text then 'skip' when pref is null and (conf >= 0.72 or certain) or pref >= 0.25 and 0.6 * conf + 0.4 * pref >= 0.72 then 'auto_approve' else 'queue' end as decision from c",
    "flt25_projected": f"{_f} select doc_id, {_slug(48)} || '_' || hash[1:4] || lower(ext) as name from files",
    "txt24_records": f"{_f} select doc_id, name, ext, dir, hash as sha256, hour as modified, size, case when root = 'src1' then 'default' else 'profile of ' || root end as profile, ext = '' as review, root as who, stem as what, day as when_day, dir as where_dir, 'inventory of ' || root as why from files",
    "grf01_nodes": f"with {_term} select term as node, count(*) as n from h group by 1",
    "grf01_edges": f"with {_term}, {_edges} select * from e",
    "grf03_anti_edges": f"with {_term}, {_edges} select a, b from (values ('sch', 'zzz'), ('ing', 'the'), ('eau', 'zzz')) v(a, b) where (a, b) not in (select (a, b) from e)",
    "grf04_followed": "with q as (select item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{3,}'))) as w from benchmark), i as (select doc_id, unnest(list_distinct(regexp_extract_all(lower(text[1:200]), '[a-z]{3,}'))) as w from documents), s as (select item_id, doc_id, count(*) as score from q join i using (w) group by 1, 2), b as (select item_id, arg_min(doc_id, (-score, doc_id)) as node from s group by 1) select item_id as query_id, node, case when node % 2 = 0 then node + 1 end as target from b",
}
