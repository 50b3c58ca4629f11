"""Queries of readers and reports, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import reports as r
from corpusloom.operators import text as t
from corpusloom.plans.text_queries import PATTERNS
from corpusloom.plans.text_queries import SQL as TEXT_SQL
from corpusloom.sources import fixtures as x
from corpusloom.sources import readers as s

MARKS = [("der ", "german"), ("the ", "english"), ("eau", "french")]
_docs = lambda f: lambda spark, d: f(x.table(spark, d, "documents"))
_files = lambda f: lambda spark, d: f(x.files(spark, d))


def _noted(docs):
    """Documents with front matter before two of three texts."""
    head = F.concat(F.lit("---\nid: "), F.col("doc_id").cast("string"), F.lit("\nlang: "), "lang", F.lit("\nsite: a:b\n---\n"))
    return docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).otherwise(F.concat(head, "text")).alias("t"))


def _groups(files):
    dup = files.groupBy("root", F.col("hash").alias("unit")).agg(F.count("*").alias("n")).where("n > 1").withColumn("kind", F.lit("duplicate"))
    names = files.groupBy("root", F.lower("name").alias("unit")).agg(F.count("*").alias("n")).where("n > 1").withColumn("kind", F.lit("name"))
    return r.anomalies(dup.unionByName(names))


def _lexicons(spark, d):
    docs = x.table(spark, d, "documents")
    seed = docs.selectExpr("lang", "source", "cast(doc_id as double) as weight").where("doc_id % 4 <> 0").groupBy("lang", "source").agg(F.max("weight").alias("weight"))
    user = docs.where("doc_id % 20 < 3").selectExpr("lang", "source", "case when doc_id % 20 = 1 then 1.5D end as weight").groupBy("lang", "source").agg(F.max("weight").alias("weight"))
    return s.merged_lexicon(seed, user, ["lang", "source"], {"weight": 0.25})


def _labels(spark, d):
    rules = spark.createDataFrame([("en", 1, ["share"]), ("de", 2, ["share", "train"]), ("long", 3, ["copy"]), ("src0", 5, ["share", "delete"])], "label string, rank int, blocks array<string>")
    docs = x.table(spark, d, "documents")
    return r.enforced(docs.select(F.col("doc_id").alias("key"), F.array_compact(F.array("lang", "source", F.when(F.col("n_chars") > 2000, F.lit("long")))).alias("labels")), rules)


def _accuracy(spark, d):
    p = x.observations(spark, d).selectExpr("ext as key", "event_id as seq", "ts as resolved_at", "case when event_id % 11 = 0 then null else cast(event_id % 4 <> 0 as int) end as correct")
    return r.accuracy(p, 200)


def _agreement(spark, d):
    docs = x.table(spark, d, "documents")
    return r.agreement(t.intensity(docs, PATTERNS), t.intensity(docs, {k: {1: v.get(3, []), 3: v.get(1, [])} for k, v in PATTERNS.items()}))


def _rotation(spark, d):
    docs = x.table(spark, d, "documents")
    return r.rotation(docs.selectExpr("source as page"), docs.where("doc_id % 20 < 15 or lang <> 'es'").selectExpr("source as page", "lang as kind"), ["de", "en", "es", "fr", "it"])


def _tree(spark, d):
    dirs = x.dirs(x.files(spark, d)).select(F.col("dir").alias("id"), F.col("parent"), F.col("base").alias("name"))
    return r.tree(dirs)


QUERIES = {
    "src05_plain_text": lambda spark, d: x.table(spark, d, "pages").select("page_id", s.plain_text(F.col("html")).alias("text")),
    "src08_front_matter": _docs(lambda v: _noted(v).select("doc_id", s.front_matter(F.col("t")).alias("m")).select("doc_id", F.col("m")["lang"].alias("lang"), F.col("m")["site"].alias("site"))),
    "src09_body": _docs(lambda v: _noted(v).select("doc_id", F.md5(s.body(F.col("t")).cast("binary")).alias("body"))),
    "src10_merged_lexicon": _lexicons,
    "src17_platform": _docs(lambda v: v.select("doc_id", s.platform(F.col("text"), MARKS).alias("platform"))),
    "flt01_admitted": _files(lambda f: s.admitted(f, [".git", "tmp", "build"], [".md", ".txt", ".pdf", ".py"], 5000)),
    "agg17_statistics": _files(r.statistics),
    "agg33_anomalies": _files(_groups),
    "agg22_accuracy": _accuracy,
    "agg36_gaps": lambda spark, d: r.gaps(x.table(spark, d, "documents").selectExpr("doc_id", "concat(source, lang) as category"), 8),
    "snk05_review_queue": _docs(lambda v: r.review_queue(v.selectExpr("source", "doc_id", "(doc_id % 50) / 50.0D as confidence", "case when doc_id % 2 = 0 then lang end as notes", "case when doc_id % 3 = 0 then source end as reason"))),
    "snk08_export_markdown": _docs(lambda v: r.exported(v.selectExpr("doc_id", "source as folder", "text as body"), "markdown")),
    "snk09_score_lines": _docs(lambda v: r.score_lines(t.intensity(v, PATTERNS))),
    "flt29_enforced_labels": _labels,
    "join20_tree": _tree,
    "join27_agreement": _agreement,
    "join29_uncovered": _docs(lambda v: r.uncovered(v, v.where("lang <> 'fr'"), ["doc_id"])),
    "win21_rotation": _rotation,
}
_f = f"with {x.FILES_SQL}"
_noted_sql = "n as (select doc_id, case when doc_id % 3 = 0 then text else '---' || chr(10) || 'id: ' || doc_id || chr(10) || 'lang: ' || lang || chr(10) || 'site: a:b' || chr(10) || '---' || chr(10) || text end as t from documents)"
_html = "html"
for _p, _to in ((r"(?is)<(script|style)\b.*?</(script|style)>", "' '"), (r"(?i)</(p|div|section|article|li|h[1-6]|tr)>", "chr(10)"), ("<[^>]+>", "' '")):
    _html = f"regexp_replace({_html}, '{_p}', {_to}, 'g')"
for _k, _v in s.ENTITIES.items():
    _html = f"replace({_html}, '{_k}', '{_v.replace(chr(39), chr(39) * 2)}')"
_lines = TEXT_SQL["txt09_intensity"]
_swapped = "select * from (" + " union all ".join(f"select doc_id, '{k}' as property, cast(case when {c3} >= 2 then 3 when {c3} >= 1 then 2 when {c1} >= 1 then 1 else 0 end as int) as level from documents" for k, v in PATTERNS.items() for c3 in ["(" + " + ".join(f"cast(regexp_matches(text, '{p}') as int)" for p in v[1]) + ")"] for c1 in ["(" + " + ".join(f"cast(regexp_matches(text, '{p}') as int)" for p in v[3]) + ")"]) + ") where level > 0"
SQL = {
    "src05_plain_text": f"select page_id, trim(regexp_replace(regexp_replace({_html}, '[ \\t\\r]+', ' ', 'g'), ' ?\\n[ \\n]*', chr(10), 'g'), ' ') as text from pages",
    "src08_front_matter": "select doc_id, case when doc_id % 3 <> 0 then lang end as lang, case when doc_id % 3 <> 0 then 'a:b' end as site from documents",
    "src09_body": "select doc_id, md5(text) as body from documents",
    "src10_merged_lexicon": "with s as (select lang, source, max(cast(doc_id as double)) as weight from documents where doc_id % 4 <> 0 group by 1, 2), u as (select lang, source, max(case when doc_id % 20 = 1 then 1.5::double end) as weight from documents where doc_id % 20 < 3 group by 1, 2) select lang, source, coalesce(weight, 0.25::double) as weight from (select * from u union all select * from s where (lang, source) not in (select (lang, source) from u))",
    "src17_platform": "select doc_id, case " + " ".join(f"when contains(lower(text), '{a}') then '{b}'" for a, b in MARKS) + " else 'unknown' end as platform from documents",
    "flt01_admitted": f"{_f} select doc_id, case when list_has_any(string_split(dir, '/'), ['.git', 'tmp', 'build']) then 'directory' when starts_with(name, '.') then 'hidden' when ext not in ('.md', '.txt', '.pdf', '.py') then 'extension' when size > 5000 then 'size' end as reason from files",
    "agg17_statistics": f"{_f}, e as (select root, ext, count(*) as n, row_number() over (partition by root order by count(*) desc, ext) as nth from files group by root, ext), tp as (select root, string_agg(ext || '=' || n, ',' order by nth) as top from e where nth <= 3 group by root), s as (select root, count(*) as n, cast(sum(size) as bigint) as bytes, count(*) - count(distinct hash) as duplicates from files group by root) select root, n, bytes, duplicates, round(duplicates / n, 6) as share, top from s join tp using (root)",
    "agg33_anomalies": f"{_f}, g as (select root, 'duplicate' as kind, hash as unit, count(*) as n from files group by root, hash having count(*) > 1 union all select root, 'name', lower(name), count(*) from files group by 1, 3 having count(*) > 1), z as (select *, cast(row_number() over (partition by root, kind order by n desc, unit) as int) as nth from g) select * from z where nth <= 3",
    "agg22_accuracy": f"with {x.OBSERVATIONS_SQL}, p as (select ext as key, cast(event_id % 4 <> 0 as int) as c, row_number() over (partition by ext order by ts desc, event_id desc) as nth from observations where event_id % 11 <> 0), s as (select key, count(*) as n, avg(c) as a from p where nth <= 200 group by key) select key, n, round(a, 6) as accuracy, case when n < 20 then 'learning' when a >= 0.9 then 'trusted' when a >= 0.7 then 'assisting' else 'watching' end as trust from s",
    "agg36_gaps": "select source || lang as category, count(distinct doc_id) as n from documents group by 1 having count(distinct doc_id) < 8",
    "snk05_review_queue": "select source, cast(row_number() over (partition by source order by (doc_id % 50) / 50.0, doc_id) as int) as nth, doc_id, coalesce(case when doc_id % 2 = 0 then lang end, case when doc_id % 3 = 0 then source end, '') as note from documents",
    "snk08_export_markdown": "select doc_id, '## ' || source || chr(10) || chr(10) || text || chr(10) || chr(10) || '---' as line from documents",
    "snk09_score_lines": f"select doc_id, string_agg(property || ': ' || level, chr(10) order by property) as block from ({_lines}) group by doc_id",
    "flt29_enforced_labels": "with r(label, rank, blocks) as (values ('en', 1, ['share']), ('de', 2, ['share', 'train']), ('long', 3, ['copy']), ('src0', 5, ['share', 'delete'])), o as (select doc_id as key, unnest([lang, source, case when n_chars > 2000 then 'long' end]) as label from documents), e as (select key, r.* from o join r on o.label = r.label) select key, arg_max(label, (rank, label)) as label, array_to_string(list_sort(list_distinct(flatten(list(blocks)))), ',') as actions from e group by key",
    "join20_tree": f"with {x.DIRS_SQL} select distinct dir as id, dir as path, cast(len(string_split(dir, '/')) - 1 as int) as depth from dirs",
    "join27_agreement": f"with a as ({_lines}), b as ({_swapped}) select * from (select coalesce(a.doc_id, b.doc_id) as doc_id, coalesce(a.property, b.property) as property, cast(abs(coalesce(a.level, 0) - coalesce(b.level, 0)) as int) as apart from a full join b on a.doc_id = b.doc_id and a.property = b.property) where apart >= 2",
    "join29_uncovered": "select doc_id from documents where lang = 'fr' or lang is null",
    "win21_rotation": "with d as (select source as page, lang as kind from documents where doc_id % 20 < 15 or lang <> 'es'), p as (select distinct source as page from documents), k(nth, kind) as (values (0, 'de'), (1, 'en'), (2, 'es'), (3, 'fr'), (4, 'it')), e as (select page, nth, kind, (page, kind) in (select (page, kind) from d) as had, (select count(*) from d where d.kind = k.kind) as total from p, k) select page, coalesce(arg_min(kind, nth) filter (not had), arg_min(kind, (total, nth))) as kind from e group by page",
}
