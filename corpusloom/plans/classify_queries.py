"""Queries of classification, gates and addresses, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import classify as k
from corpusloom.operators import text as t
from corpusloom.sources import fixtures as x

RULES = [("*.pdf", "library", 5), ("src0/*", "inbox", 9), ("*/en/doc_*.md", "english", 9), ("*invoice*", "finance", 2)]
GROUPS = [(["tion"], "TIO"), (["der ", "die "], "GER"), (["the "], "ENG"), (["eau"], "FRE"), (["ing"], "ING")]
AXES = [("size", 1, "long", 5000, None), ("size", 2, "medium", 500, None), ("size", 3, "short", None, None), ("spread", 1, "late", None, 200), ("spread", 2, "early", None, None)]
WEIGHTS = {"names": 2.0, "exts": 1.0, "hashes": 3.0}
_files = lambda f: lambda s, d: f(x.files(s, d))


def _suggestions(f):
    return f.selectExpr("doc_id", "path", "case when doc_id % 3 = 0 then path else dir || '/renamed' end as target", "ext", "(doc_id % 100) / 100.0D as confidence", "doc_id % 41 = 0 as protected", "doc_id % 29 = 0 as review_only", "case when doc_id % 3 = 1 then 0.5D end as least")


def _roots(f):
    return f.where("stem in ('package', 'requirements')").select("root", "dir")


def _layered(s, d):
    docs = x.table(s, d, "documents").selectExpr("cast(doc_id as string) as key", "doc_id", "lang", "source")
    markers = docs.where("doc_id % 5 = 0").selectExpr("key", "lang as mode", "cast(null as string) as owner")
    profiles = docs.where("doc_id % 3 = 0").selectExpr("key", "'profile' as mode", "source as owner")
    return k.layered(docs.select("key"), markers, profiles, {"mode": "default", "owner": "nobody"})


def _axes(s, d):
    rules = s.createDataFrame(AXES, "axis string, priority int, output string, min_size long, min_day long")
    return k.first_rule(x.files(s, d).select("doc_id", "size", "day"), rules, "doc_id", ["size", "day"])


def _vectors(s, d):
    docs = x.table(s, d, "documents")
    return docs.select("doc_id", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: ((F.col("doc_id") * (i + 3)) % 31).cast("double") / 10).alias("v"))


def _pairs(s, d):
    terms = [("en", w, 1.0) for w in ("tion", "the", "eau", "sch", "ing", "ón", "and")]
    return k.cooccurrence(t.term_counts(x.table(s, d, "documents"), terms))


QUERIES = {
    "flt16_content_type": _files(k.content_type),
    "flt17_lifecycle": _files(lambda f: k.lifecycle(f, x.AS_OF)),
    "flt14_blocked": _files(lambda f: k.blocked(f, [".git", "tmp"], _roots(f), f.sparkSession.createDataFrame([("src2", True), ("src3", False)], "root string, protected boolean"))),
    "flt15_review_gate": _files(lambda f: k.review_gate(_suggestions(f), f)),
    "flt26_tags": lambda s, d: k.tags(x.table(s, d, "documents"), GROUPS),
    "flt27_slug": _files(k.slug),
    "join13_glob_rule": _files(lambda f: k.matching_rule(f, RULES)),
    "join14_first_rule": _axes,
    "join16_group_scores": _files(lambda f: k.group_scores(f, WEIGHTS)),
    "join23_resolution": _files(k.resolution),
    "join28_layered_settings": _layered,
    "txt20_address": lambda s, d: k.address(_vectors(s, d)).select("doc_id", "code"),
    "txt20_decoded": lambda s, d: k.decoded(k.address(_vectors(s, d))).select("doc_id", F.array_join(F.col("levels").cast("array<string>"), "").alias("levels")),
    "grf02_cooccurrence": _pairs,
}
_f = f"with {x.FILES_SQL}"
_in = lambda v: "(" + ", ".join(f"'{a}'" for a in v) + ")"
_globs = {"*.pdf": "^.*\\.pdf$", "src0/*": "^src0/.*$", "*/en/doc_*.md": "^.*/en/doc_.*\\.md$", "*invoice*": "^.*invoice.*$"}
_q = "list_transform(range(0, 10), lambda i: case when ((doc_id * (i + 3)) % 31) / 10 < 0.75 then 0 when ((doc_id * (i + 3)) % 31) / 10 < 1.5 then 1 when ((doc_id * (i + 3)) % 31) / 10 < 2.25 then 2 else 3 end)"
_sets = lambda e: f"(select distinct dir, {e} as e from files)"
_jac = lambda e, w: f"select a.dir as source, b.dir as target, {w} * count(*) / ((select count(*) from {_sets(e)} s where s.dir = a.dir) + (select count(*) from {_sets(e)} s where s.dir = b.dir) - count(*)) as v from {_sets(e)} a join {_sets(e)} b on a.e = b.e and a.dir <> b.dir group by a.dir, b.dir"
SQL = {
    "flt16_content_type": f"{_f} select doc_id, case when ext in {_in(k.TYPES['document'])} and regexp_matches(lower(content), '{k.PAPER}') then 'paper' " + " ".join(f"when ext in {_in(v)} then '{n}'" for n, v in k.TYPES.items()) + " when content <> '' then 'note' else 'binary' end as content_type from files",
    "flt17_lifecycle": f"{_f} select doc_id, case " + " ".join(f"when regexp_matches(lower(name), '{v}') then '{n}'" for n, v in k.STATES.items()) + f" when {x.AS_OF} - day > 180 then 'archive' else 'active' end as state from files",
    "flt14_blocked": f"{_f} select * from (select doc_id, case when root = 'src2' then 'protected_folder_profile' when list_has_any(string_split(dir, '/'), ['.git', 'tmp']) then 'protected_directory' when regexp_matches(lower(name), '{k.SECRET_NAME}') then 'secret_or_credential_name' when (root, dir) in (select (root, dir) from files where stem in ('package', 'requirements')) then 'program_root' end as reason from files) where reason is not null",
    "flt15_review_gate": f"{_f}, s as (select doc_id, ext, case when doc_id % 3 = 0 then path else dir || '/renamed' end as target, (doc_id % 100) / 100.0 as confidence from files), r as (select doc_id, case when doc_id % 41 = 0 then 'protected_folder' when doc_id % 29 = 0 then 'folder_review_only' when lower(ext) in ('.exe', '.dll', '.sh', '.bat', '.cmd', '.ps1') then 'risky_file_type' when target in (select path from files) then 'target_exists' when confidence < case when doc_id % 3 = 1 then 0.5 else 0.98 end then 'low_confidence' else 'auto_approved_threshold' end as reason from s) select doc_id, reason <> 'auto_approved_threshold' as review, reason from r",
    "flt26_tags": "select doc_id, array_to_string(list_filter([" + ", ".join("case when " + " or ".join(f"contains(lower(text), '{w}')" for w in ws) + f" then '{c}' end" for ws, c in GROUPS) + "], lambda c: c is not null)[1:3], ',') as tags from documents",
    "flt27_slug": f"{_f}, w as (select doc_id, list_filter(string_split_regex(trim(regexp_replace(stem, '{k.JUNK_WORDS}', '', 'g')), '[_\\-\\s]+'), lambda w: length(w) > 2)[1:4] as w from files) select doc_id, case when len(w) = 0 then 'untitled' else lower(array_to_string(w, '-')) end as slug from w",
    "join13_glob_rule": f"{_f} select * from (select doc_id, case " + " ".join(f"when regexp_matches(lower(path), '{_globs[p]}') then '{d}'" for p, d, _ in sorted(RULES, key=lambda r: (-r[2], r[0]))) + " end as destination from files) where destination is not null",
    "join14_first_rule": f"{_f}, r(axis, priority, output, min_size, min_day) as (values " + ", ".join("(" + ", ".join("null" if v is None else repr(v) for v in r) + ")" for r in AXES) + ") select doc_id, axis, arg_min(output, priority) as output from files join r on coalesce(size >= min_size, true) and coalesce(day >= min_day, true) group by doc_id, axis",
    "join16_group_scores": f"{_f}, e as ({_jac('lower(name)', 2.0)} union all {_jac('ext', 1.0)} union all {_jac('hash', 3.0)}), r as (select source, target, round(sum(v), 9) as raw from e group by source, target), z as (select *, row_number() over w as nth, lead(raw) over w as nxt from r window w as (partition by source order by raw desc, target)) select source, target, round(raw, 6) as raw, round(case when nxt is null then 1.0 else (raw - nxt) / greatest(1.0, raw) end, 6) as margin from z where nth = 1",
    "join23_resolution": f"{_f} select doc_id, case when count(*) over (partition by root, hash) > 1 then 'IDENTICAL' when (select count(distinct g.hash) from files g where g.root = f.root and lower(g.name) = lower(f.name)) > 1 then 'CONTENT_CONFLICT' when regexp_matches(lower(path), 'signed|legal|original') then 'PROTECTED_ORIGINAL' when ext in ('.html', '.pdf', '.docx') then 'DERIVED_OUTPUT' else 'UNIQUE_ADDITION' end as state from files f",
    "join28_layered_settings": "select cast(doc_id as varchar) as key, case when doc_id % 5 = 0 then lang when doc_id % 3 = 0 then 'profile' else 'default' end as mode, case when doc_id % 3 = 0 then source else 'nobody' end as owner from documents",
    "txt20_address": f"with b as (select doc_id, list_reduce(list_prepend(0, {_q}), lambda a, q: a * 4 + q) as b from documents) select doc_id, " + " || ".join(f"substring('{k.ALPHABET}', cast((b >> {15 - 5 * i}) & 31 as int) + 1, 1)" for i in range(4)) + " as code from b",
    "txt20_decoded": f"select doc_id, array_to_string({_q}, '') as levels from documents",
    "grf02_cooccurrence": "with w as (select doc_id, term from documents, (select unnest(['tion', 'the', 'eau', 'sch', 'ing', 'ón', 'and']) as term) where contains(lower(text), term)) select x.term as a, y.term as b, count(*) as n from w x join w y on x.doc_id = y.doc_id and x.term < y.term group by 1, 2 having count(*) >= 2",
}
