"""Queries of text scoring, conversations, similarity and listings, and their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import conversations as c
from corpusloom.operators import listing, similarity
from corpusloom.operators import text as t
from corpusloom.sources import fixtures as x

#: A lexicon of frequent words of the supplied texts.
LEXICON = [(k, w, s) for k, ws, s in (("en", ("the", "of", "and", "tion"), 1.0), ("de", ("der", "die", "und", "sch"), 1.5), ("fr", ("le", "les", "des", "eau"), 2.0), ("es", ("el", "los", "por", "ción"), 1.0)) for w in ws]
ORDER, REGULATED = ["en", "de", "fr", "es"], ["de", "es"]
PATTERNS = {"marks": {3: ["[*]{3}", "[#]{3}"], 2: ["[$]", "!"], 1: [","]}, "english": {3: [" the ", " of "], 2: [" and "], 1: [" a "]}}
STOP = ["that", "this", "with", "from"]
_docs = lambda f: lambda s, d: f(x.table(s, d, "documents"))


def _items(spark, sf_dir):
    return x.table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"), F.col("source").alias("folder"), F.array("lang").alias("tags"), (F.col("doc_id") % 17 == 0).alias("pinned"))


def _chunks(spark, sf_dir):
    one = x.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("text"), F.min("role").alias("role"))
    return one.select("conv_id", "turn", "text", F.when(F.col("role") == "user", "human").otherwise(F.col("role")).alias("speaker"))


def _similar(spark, sf_dir):
    return c.adjacent(c.embed(_chunks(spark, sf_dir)), "conv_id", "turn")


def _topics(spark, sf_dir):
    return c.topics(_similar(spark, sf_dir), "conv_id", "turn", 0.6, 2)


def _merged(spark, sf_dir):
    chunks = c.embed(_chunks(spark, sf_dir)).join(_topics(spark, sf_dir), ["conv_id", "turn"])
    return c.merge_topics(chunks, "conv_id", "turn", 0.6)


def _talk(spark, sf_dir):
    """Conversations as one text each, with a speaker before every turn."""
    lines = _chunks(spark, sf_dir).select("conv_id", "turn", F.concat(F.initcap("speaker"), F.lit(": "), "text").alias("line"))
    return lines.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda y: y["line"]), "\n").alias("text")).withColumnRenamed("conv_id", "doc_id")


def _packet(spark, sf_dir):
    docs = x.table(spark, sf_dir, "documents").selectExpr("source", "doc_id as rank", "n_chars as length")
    return c.packet(docs, "source", 5000)


def _vectors(spark, sf_dir):
    v = x.table(spark, sf_dir, "embeddings")
    return similarity.nearest_vectors(v.where("vec_id % 100 = 0"), v)


def _names(spark, sf_dir):
    files = x.files(spark, sf_dir)
    return similarity.nearest_names(files.where("doc_id % 100 = 0").select("name").distinct(), files.select("name").distinct())


def _enriched(spark, sf_dir):
    """Names with a domain and tags, of which some have none of their own."""
    files = x.files(spark, sf_dir)
    items = files.groupBy("name").agg(F.min("doc_id").alias("doc_id")).select("name", F.expr("case when doc_id % 4 = 0 then 'GN' else 'd' || (doc_id % 3) end").alias("domain"), F.expr("array('t' || (doc_id % 5), 'u' || (doc_id % 2))").alias("tags"))
    return similarity.enriched(_names(spark, sf_dir), items)


#: Lines that some texts get, so that every verdict occurs; and the front matter of some.
TALK_LINES = ["Absolutely!", "\tHello there ", "Wait, that's not it. Actually I was wrong.", " \t ", "Hence the proof", "You're welcome", "ok", "Good morning!\x0b"]
_talk_line = "case doc_id % 9 " + " ".join(f"when {i} then '" + t.replace("'", "''").replace("\t", "' || chr(9) || '").replace("\x0b", "' || chr(11) || '") + "'" for i, t in enumerate(TALK_LINES)) + " else '' end"
_front = "case doc_id % 5 when 0 then '---' || chr(10) || 'stage: \"segmented\"' || chr(10) || '  curated: false' || chr(10) || '---' || chr(10) when 1 then '--- no end' when 2 then '---' || chr(10) || 'curated: true' || chr(10) || 'curated_at: x' || chr(10) || '---' else '' end"
TALK_TEXT = f"{_front} || {_talk_line} || chr(10) || coalesce(text, '') || chr(10) || {_talk_line}"


def _pages_of_talk(s, d):
    return x.table(s, d, "documents").select("doc_id", F.expr(TALK_TEXT.replace("''s", "\\'s").replace("''re", "\\'re")).alias("text"))


def _flat_pages(df):
    flat = lambda c: F.array_join(F.transform(c, lambda v: F.concat_ws(":", v["nth"].cast("string"), v["text"])), "|")
    return df.withColumns({"page": F.sha2(F.col("page").cast("binary"), 256), "cuts": flat("cuts"), "corrections": flat("corrections")})


#: Texts with enough of a regulated category's terms that it comes near the top, or passes it; and a registry of access.
GATED_TEXT = "coalesce(text, '') || case when doc_id % 5 = 1 then repeat(' sch', cast(n_chars div 45 as int)) else '' end"
REGISTRY = [("en", "BUSINESS", "partial", ["web"], "process_deep", "process_shallow"), ("de", "REGULATED", "missing", ["registry", "case_law"], "process_deep", "block_pending"), ("fr", "ORIGINAL", "have", [], "process_deep", "review"), ("uncategorized", "UNKNOWN", "have", [], "review", "review")]


def _gated(s, d):
    return t.gate(x.table(s, d, "documents").withColumn("text", F.expr(GATED_TEXT)), LEXICON, REGULATED)


def _routes(s, d):
    return t.gate_routes(_gated(s, d), s.createDataFrame(REGISTRY, "category string, tier string, access string, sources array<string>, route_available string, route_blocked string"))


QUERIES = {
    "txt07_term_counts": _docs(lambda d: t.term_counts(d, LEXICON)),
    "txt04_profile": _docs(lambda d: t.profile(d, LEXICON)),
    "txt06_primary": _docs(lambda d: t.primary(t.profile(d, LEXICON), ORDER)),
    "txt08_gate": _gated,
    "txt08_routes": lambda s, d: _routes(s, d).withColumn("sources", F.array_join("sources", ",")),
    "agg05_access_report": lambda s, d: t.access_report(_routes(s, d), "block_pending"),
    "txt09_intensity": _docs(lambda d: t.intensity(d, PATTERNS)),
    "txt14_balance": _docs(lambda d: t.stage_balance(d, ["the", "and", "is"], ["not", "was", "to"])),
    "txt16_word_scores": lambda s, d: t.word_scores(x.table(s, d, "documents"), s.createDataFrame(LEXICON, "category string, term string, weight double")),
    "txt01_sentences": _docs(t.sentences),
    "txt01_paragraphs": _docs(t.paragraphs),
    "txt02_spans": _docs(lambda d: t.spans(d, [("tion", 1.0), ("the", 0.5), ("a.", 2.0)])),
    "txt25_snippets": _docs(lambda d: t.snippets(d, "ing", 20)),
    "agg12_frequent_terms": _docs(lambda d: t.frequent_terms(d, STOP)),
    "agg27_simhash": _docs(t.simhash),
    "agg28_section_hashes": _docs(t.section_hashes),
    "win10_sections": _docs(t.sections),
    "agg29_set_similarity": lambda s, d: similarity.set_similarity(c.word_sets(_chunks(s, d), "conv_id", "turn"), "words", "before").select("conv_id", "turn", F.round("jaccard", 6).alias("jaccard")),
    "udf09_near_fingerprints": _docs(lambda d: similarity.near_fingerprints(t.simhash(d))),
    "join17_nearest_names": _names,
    "join17_enriched": lambda s, d: _enriched(s, d).withColumn("tags", F.array_join("tags", ",")),
    "join18_nearest_vectors": _vectors,
    "win01_adjacent_similarity": _similar,
    "win02_topics": _topics,
    "win03_merged_topics": _merged,
    "win11_turns": lambda s, d: c.turns(_talk(s, d)),
    "win12_packet": _packet,
    "txt27_titles": lambda s, d: c.titles(_chunks(s, d), "conv_id", "turn"),
    "txt29_line_verdicts": lambda s, d: c.line_verdicts(_pages_of_talk(s, d)),
    "txt29_curated_pages": lambda s, d: _flat_pages(c.curated(_pages_of_talk(s, d), "2024-02-01T00:00:00")),
    "agg16_curation_stats": lambda s, d: c.curation_stats(_pages_of_talk(s, d)),
    "flt03_items": lambda s, d: listing.items(_items(s, d), tag="en", query="tion").select("doc_id", "folder", "pinned"),
    "flt05_top_items": lambda s, d: listing.items(_items(s, d), most=25).select("doc_id", "pinned"),
    "flt08_under_folder": lambda s, d: listing.under(x.files(s, d), "src1/en").select("doc_id", "path"),
    "flt13_secret_warning": lambda s, d: listing.secret_warning(_items(s, d)),
    "srt02_search_top": lambda s, d: listing.search(_items(s, d), "the tion", 50),
    "srt02_search_all": lambda s, d: listing.search_all(_items(s, d), "the tion"),
    "set06_combined": lambda s, d: listing.combined(_items(s, d), "folder", "doc_id"),
}
_lex = "lex(category, term, weight, ord) as (values " + ", ".join(f"('{k}', '{w}', {s}::double, {ORDER.index(k)})" for k, w, s in LEXICON) + ")"
_counts = f"{_lex}, h as (select doc_id, category, term, weight, ord, cast((length(text) - length(replace(lower(text), term, ''))) // length(term) as bigint) as n from documents, lex), hits as (select * from h where n > 0), sc as (select doc_id, category, ord, sum(n * weight) as score, sum(n) as n from hits group by doc_id, category, ord)"
_chunk = "ch as (select conv_id, turn, min(text) as text, case min(role) when 'user' then 'human' else min(role) end as speaker from conversations group by conv_id, turn)"
_emb = f"{_chunk}, tok as (select conv_id, turn, sha256(w) as h from (select conv_id, turn, unnest(regexp_extract_all(lower(text), '[a-z0-9_]+')) as w from ch)), cell as (select conv_id, turn, cast(('0x' || h[1:8])::ubigint % 64 as int) as i, sum(case when ('0x' || h[9:10])::int % 2 = 0 then 1.0 else -1.0 end) as s from tok group by 1, 2, 3), nrm as (select conv_id, turn, sqrt(sum(s * s)) as nn from cell group by 1, 2), e as (select conv_id, turn, i, case when nn > 0 then round(s / nn, 6) else 0 end as v from cell join nrm using (conv_id, turn)), o as (select conv_id, turn, lag(turn) over (partition by conv_id order by turn) as before from ch), sim as (select o.conv_id, o.turn, case when before is not null then round(coalesce((select sum(a.v * b.v) from e a join e b using (i) where a.conv_id = o.conv_id and a.turn = o.turn and b.conv_id = o.conv_id and b.turn = o.before), 0), 6) end as similarity from o)"
#: The patterns once more, as the SQL's own literals.
_correction = r"(i\s+was\s+wrong|that'?s?\s+(not\s+)?(right|correct|accurate))|(actually|correction|let\s+me\s+correct|i\s+(need\s+to\s+)?revise)|((on\s+)?second\s+thought|wait.*?that'?s?\s+not)|(previous(ly)?\s+(said|claimed|stated).*?(but|however|wrong))|(supersed(ed?|es)|replaced?\s+by|no\s+longer\s+(true|valid|correct))"
_keep = r"equation|formula|theorem|axiom|law\s+\d|derivat|proof|lemma|therefore|thus|hence|it\s+follows|QED|∴|[A-Z]_\{|\\frac|\\int|\\sum|\\nabla|χ|Φ|ψ|∫|∑|∇|sigma|p-value|confidence|correlation|r\s*=|p\s*[<>=]|scripture|verse|chapter|genesis|exodus|galatians|john|romans|matthew|grace|entropy|coherence|negentropy|master\s+equation|lagrangian"
_cut = r"^that'?s?\s+(a\s+)?(great|excellent|wonderful|interesting)\s+(question|point|observation)|^glad\s+you\s+(asked|mentioned|brought)|^(absolutely|definitely|certainly)[.!]?\s*$|^(i'?d\s+be\s+happy|happy)\s+to\s+help|^(sure|of course)[,.]?\s*(let'?s|i'?ll)|^(thanks?\s+for\s+sharing|thank\s+you\s+for)|^(hey|hi|hello|good\s+(morning|afternoon|evening))[\s,!.]*$|^(talk\s+later|bye|goodbye|see\s+you|take\s+care)|^(sorry\s+(about\s+that|for\s+the))|^(you'?re\s+welcome|no\s+problem|my\s+pleasure)"
_re = lambda p: "(?i)" + p.replace("'", "''")
_case = f"case when regexp_matches(line, '{_re(_correction)}') then 'correction' when length(s) < 5 then 'cut' when regexp_matches(s, '{_re(_keep)}') then 'kept' when regexp_matches(s, '{_re(_cut)}') then 'cut' else 'kept' end"
_trim = "trim({}, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
_verdicts = f"talk_ as (select doc_id, {TALK_TEXT} as text from documents), v as (select doc_id, nth, {_case} as verdict from (select doc_id, cast(i - 1 as int) as nth, l[i] as line, {_trim.format('l[i]')} as s from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, chr(10)) as l from talk_))))"
_pages_sql = (
    f"talk_ as (select doc_id, {TALK_TEXT} as text from documents), hd as (select doc_id, text, case when starts_with(text, '---') and strpos(text[4:], '---') > 0 then text[1:strpos(text[4:], '---') + 5] else '' end as head from talk_), mk as (select doc_id, replace(replace(head, 'stage: \"segmented\"', 'stage: \"curated\"'), 'curated: false', 'curated: true') as m, text[length(head) + 1:] as body from hd), "
    "mk2 as (select doc_id, case when contains(m, 'curated_at') then m else replace(m, 'curated: true', 'curated: true' || chr(10) || '  curated_at: \"2024-02-01T00:00:00\"') end as head, string_split(body, chr(10)) as l from mk), "
    f"ln as (select doc_id, i - 1 as nth, line, s, {_case} as verdict from (select doc_id, i, l[i] as line, {_trim.format('l[i]')} as s from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from mk2))), "
    "ag as (select doc_id, cast(count(*) as int) as n_lines, cast(count(*) filter (verdict <> 'cut') as int) as n_kept, cast(count(*) filter (verdict = 'cut') as int) as n_cut, cast(count(*) filter (verdict = 'correction') as int) as n_corrections, string_agg(line, chr(10) order by nth) filter (verdict <> 'cut') as kept, coalesce(string_agg(nth || ':' || s[1:100], '|' order by nth) filter (verdict = 'cut' and s <> ''), '') as cuts, coalesce(string_agg(nth || ':' || s, '|' order by nth) filter (verdict = 'correction'), '') as corrections from ln group by doc_id)"
)
_sections = "sec as (select doc_id, cast(sum(cast(regexp_matches(line, '^(#{1,6}\\s|[A-Z]\\w*\\.$)') as int)) over (partition by doc_id order by nth) as bigint) as section, nth, line from (select doc_id, cast(i - 1 as int) as nth, l[i] as line from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, chr(10)) as l from documents))))"
_simhash = "wd as (select doc_id, w, count(*) as n, md5(w) as h from (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9_]{3,}')) as w from documents) group by doc_id, w), vb as (select doc_id, i, sum(case when (('0x' || h[17 + 8 * (i // 32):24 + 8 * (i // 32)])::ubigint >> (31 - i % 32)::ubigint) & 1 = 1 then n else -n end) as v from (select *, unnest(range(0, 64)) as i from wd) group by doc_id, i), sh as (select doc_id, string_agg(case when v > 0 then '1' else '0' end, '' order by i) as simhash from vb group by doc_id)"
_talk_sql = f"{_chunk}, talk as (select conv_id as doc_id, string_agg(upper(speaker[1]) || speaker[2:] || ': ' || text, chr(10) order by turn) as text from ch group by conv_id)"
_level = lambda tiers: "case when {3} >= 2 then 3 when {3} >= 1 or {2} >= 2 then 2 when {2} >= 1 or {1} >= 1 then 1 else 0 end".format(*["0"] + ["(" + " + ".join(f"cast(regexp_matches(text, '{p}') as int)" for p in tiers.get(k, [])) + ")" for k in (1, 2, 3)])
_gated_docs = f"gated_docs as (select * replace ({GATED_TEXT.replace(' div ', ' // ')} as text) from documents)"
_gate_sql = f"with {_gated_docs}, {_counts.replace('from documents', 'from gated_docs').replace('join documents', 'join gated_docs')}, d as (select doc_id, category, round(sc.n * 1000.0 / greatest(1, len(regexp_extract_all(lower(text), '[a-z0-9]+'))), 3) as d from sc join gated_docs using (doc_id)), top as (select doc_id, max(d) as d0, arg_min(category, (-d, category)) as c0, max(d) filter (category in ('de', 'es')) as d1, arg_min(category, (-d, category)) filter (category in ('de', 'es')) as c1 from d group by doc_id), r as (select *, c0 not in ('de', 'es') and coalesce(d1 >= d0 * 0.6, false) as overridden from top) select doc_id, case when not overridden and d0 < 0.5 then 'uncategorized' when overridden then c1 else c0 end as category, case when overridden then d1 else d0 end as per_1000, overridden from r"
_registry = "reg(category, tier, access, sources, go, stop_) as (values ('en', 'BUSINESS', 'partial', 'web', 'process_deep', 'process_shallow'), ('de', 'REGULATED', 'missing', 'registry,case_law', 'process_deep', 'block_pending'), ('fr', 'ORIGINAL', 'have', '', 'process_deep', 'review'), ('uncategorized', 'UNKNOWN', 'have', '', 'review', 'review'))"
SQL = {
    "txt07_term_counts": f"with {_counts} select doc_id, category, term, weight, n from hits",
    "txt04_profile": f"with {_counts} select doc_id, category, score, round(100 * score / sum(score) over (partition by doc_id), 4) as percent from sc",
    "txt06_primary": f"with {_counts}, r as (select doc_id, category, score, row_number() over w as nth, lead(category) over w as second, lead(score) over w as nxt from sc window w as (partition by doc_id order by score desc, ord)) select doc_id, category as first, second, score - coalesce(nxt, 0) as margin from r where nth = 1",
    "txt08_gate": _gate_sql,
    "txt08_routes": f"with g as ({_gate_sql}), {_registry} select doc_id, g.category, overridden, tier, access, case access when 'have' then go when 'partial' then 'process_shallow' else stop_ end as route, case access when 'have' then 'required source available' when 'partial' then 'partial access, light work now and the rest later' else 'required source not configured' end as reason, sources from g join reg on reg.category = case when g.category in ('en', 'de', 'fr') then g.category else 'uncategorized' end",
    "agg05_access_report": f"with g as ({_gate_sql}), {_registry}, r as (select g.category, overridden, tier, sources, case access when 'have' then go when 'partial' then 'process_shallow' else stop_ end as route from g join reg on reg.category = case when g.category in ('en', 'de', 'fr') then g.category else 'uncategorized' end) select 'route' as part, route as value, count(*) as n from r group by 2 union all select 'tier', tier, count(*) from r group by 2 union all select 'overridden', cast(overridden as varchar), count(*) from r group by 2 union all select 'needs_access', category || ':' || src, count(*) from (select category, unnest(string_split(sources, ',')) as src from r where route = 'block_pending') group by 2",
    "txt09_intensity": "select * from (" + " union all ".join(f"select doc_id, '{k}' as property, cast({_level(v)} as int) as level from documents" for k, v in PATTERNS.items()) + ") where level > 0",
    "txt14_balance": "select doc_id, cast(g as int) as good, cast(b as int) as bad, case when g > b then 'positive' when g < b then 'negative' else 'even' end as balance from (select doc_id, len(list_intersect(w, ['the', 'and', 'is'])) as g, len(list_intersect(w, ['not', 'was', 'to'])) as b from (select doc_id, list_distinct(regexp_extract_all(lower(text), '[a-z]{2,}')) as w from documents))",
    "txt16_word_scores": f"with {_lex}, w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) as term from documents) select doc_id, category, count(*) as n, sum(weight) as score from w join lex using (term) group by doc_id, category",
    "txt01_sentences": "select doc_id, cast(i - 1 as int) as nth, l[i] as sentence from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, list_filter(list_transform(string_split(regexp_replace(trim(regexp_replace(text, '\\s+', ' ', 'g')), '([.!?])\\s+([A-Z0-9])', '\\1' || chr(1) || '\\2', 'g'), chr(1)), lambda s: trim(s)), lambda s: length(s) >= 20) as l from documents))",
    "txt01_paragraphs": "select doc_id, cast(i - 1 as int) as nth, cast(l[i] as int) as n_words from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda p: len(list_filter(string_split(p, ' '), lambda w: w <> ''))), lambda n: n >= 4) as l from documents))",
    "txt02_spans": "with l(term, contribution) as (values ('tion', 1.0::double), ('the', 0.5), ('a.', 2.0)), p as (select doc_id, term, contribution, string_split(lower(text), term) as p from documents, l where contains(lower(text), term)), q as (select doc_id, term, contribution, i, len(p) as n, length(p[i]) as k from (select *, unnest(range(1, len(p) + 1)) as i from p)), r as (select *, cast(sum(k) over (partition by doc_id, term order by i) + (i - 1) * length(term) as int) as start from q) select doc_id, term, start, cast(start + length(term) as int) as \"end\", contribution from r where i < n",
    "txt25_snippets": "with p as (select doc_id, text, string_split(lower(text), 'ing') as p from documents where contains(lower(text), 'ing')), q as (select *, unnest(range(1, least(4, len(p)))) as i from p), r as (select doc_id, text, cast(i - 1 as int) as nth, cast(list_sum(list_transform(p[1:i], lambda y: length(y))) + (i - 1) * 3 + 1 as bigint) as a from q) select doc_id, nth, substring(text, greatest(1, a - 20), a - greatest(1, a - 20) + 23) as snippet from r",
    "agg12_frequent_terms": f"with w as (select doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{{4,}}')) as w from documents), n as (select doc_id, w, row_number() over (partition by doc_id order by count(*) desc, w) as nth from w where w not in ({', '.join(map(repr, STOP))}) group by doc_id, w) select doc_id, string_agg(w, ',' order by nth) as terms from n where nth <= 3 group by doc_id",
    "agg28_section_hashes": f"with {_sections}, k as (select doc_id, section, nth, lower(trim(regexp_replace(line, '\\s+', ' ', 'g'))) as x from sec where trim(line, ' ') <> ''), v as (select doc_id, section, sha256(string_agg(x, chr(10) order by nth)) as hash from k group by doc_id, section) select doc_id, 1 as level, section, hash from v union all select doc_id, 0, null, sha256(string_agg(hash, '|' order by section)) from v group by doc_id",
    "win10_sections": f"with {_sections} select * from sec",
    "agg27_simhash": f"with {_simhash} select doc_id, simhash from sh",
    "udf09_near_fingerprints": f"with {_simhash}, cl as (select simhash, min(doc_id) as class_id from sh group by simhash), nr as (select a.class_id, count(*) as near from cl a join cl b on a.class_id <> b.class_id and 64 - list_sum(list_transform(range(1, 65), lambda i: case when a.simhash[i] = b.simhash[i] then 1 else 0 end)) <= 3 group by a.class_id) select doc_id, class_id, cast(coalesce(near, 0) as bigint) as near from sh join cl using (simhash) left join nr using (class_id)",
    "agg29_set_similarity": f"with {_chunk}, s as (select conv_id, turn, list_distinct(regexp_extract_all(lower(text), '[a-z]+')) as w from ch), b as (select *, lag(w) over (partition by conv_id order by turn) as b from s) select conv_id, turn, round(case when len(list_distinct(w || coalesce(b, []))) = 0 then 0 else len(list_intersect(w, coalesce(b, []))) / len(list_distinct(w || coalesce(b, []))) end, 6) as jaccard from b",
    "win02_topics": f"with recursive {_emb}, n as (select conv_id, turn, similarity, row_number() over (partition by conv_id order by turn) as i from sim), f as (select conv_id, i, 0 as topic, 1 as size from n where i = 1 union all select n.conv_id, n.i, f.topic + cast(f.size >= 2 and coalesce(n.similarity < 0.6, false) as int), case when f.size >= 2 and coalesce(n.similarity < 0.6, false) then 1 else f.size + 1 end from f join n on n.conv_id = f.conv_id and n.i = f.i + 1) select conv_id, turn, topic from f join n using (conv_id, i)",
    "join17_nearest_names": f"with {x.FILES_SQL}, nm as (select distinct name from files), g as (select name, g, count(*) as k from (select name, unnest(list_transform(range(1, greatest(1, length(name) - 2) + 1), lambda i: lower(name)[i:i + 2])) as g from nm) group by name, g), idf as (select g, ln((1 + (select count(*) from nm)) / (1 + count(*))) + 1 as idf from g group by g), w as (select name, g, k * idf / sqrt(sum(k * idf * k * idf) over (partition by name)) as w from g join idf using (g)), s as (select a.name as query, b.name, round(sum(a.w * b.w), 6) as similarity from w a join w b using (g) where a.name <> b.name and a.name in (select name from files where doc_id % 100 = 0) group by a.name, b.name) select * from s qualify row_number() over (partition by query order by similarity desc, name) <= 6",
    "join18_nearest_vectors": "with v as (select vec_id, embedding::double[] as e from embeddings), p as (select q.vec_id as query_id, v.vec_id, round(list_dot_product(q.e, v.e) / (sqrt(list_dot_product(q.e, q.e)) * sqrt(list_dot_product(v.e, v.e))), 6) as similarity from v q join v on q.vec_id <> v.vec_id where q.vec_id % 100 = 0) select * from p where similarity > 0 qualify row_number() over (partition by query_id order by similarity desc, vec_id desc) <= 6",
    "win01_adjacent_similarity": f"with {_emb} select * from sim",
    "win11_turns": f"with {_talk_sql}, l as (select doc_id, i, l[i] as line from (select doc_id, l, unnest(range(1, len(l) + 1)) as i from (select doc_id, string_split(text, chr(10)) as l from talk))), m as (select *, case when regexp_matches(line, '(?i)^(?:\\*\\*)?(?:h|human|user)(?:\\*\\*)?[:\\s]') then 'human' when regexp_matches(line, '(?i)^(?:\\*\\*)?(?:a|assistant|ai)(?:\\*\\*)?[:\\s]') then 'assistant' end as speaker from l), n as (select *, count(speaker) over (partition by doc_id order by i rows unbounded preceding) as turn from m) select doc_id, turn, max(speaker) as speaker, count(*) as n_lines, cast(length(trim(string_agg(line, chr(10) order by i))) as int) as n_chars from n where turn > 0 group by doc_id, turn having length(trim(string_agg(line, chr(10) order by i))) > 20",
    "win12_packet": "select * from (select source, doc_id as rank, n_chars as length, cast(sum(n_chars) over (partition by source order by doc_id rows unbounded preceding) as bigint) as used from documents) where used <= 5000",
    "txt27_titles": f"with {_chunk}, r as (select conv_id, arg_min(text, turn) filter (speaker = 'human') as h, arg_min(text, turn) as f from ch group by conv_id), q as (select *, trim(regexp_replace(string_split(h, chr(10))[1][1:60], '[<>:\"/\\\\|?*]', '', 'g')) as clean from r) select conv_id, case when clean <> '' then clean else 'topic_' || md5(f)[1:8] end as title from q",
    "txt29_line_verdicts": f"with {_verdicts} select * from v",
    "txt29_curated_pages": f"with {_pages_sql} select doc_id, sha256(head || coalesce(kept, '')) as page, n_lines, n_kept, n_cut, n_corrections, round(100 * n_cut / greatest(n_lines, 1), 1) as cut_share, cuts, corrections from ag join mk2 using (doc_id)",
    "agg16_curation_stats": f"with {_verdicts} select verdict, doc_id, count(*) as n from v group by verdict, doc_id union all select verdict, null, count(*) from v group by verdict",
    "flt03_items": "select doc_id, source as folder, doc_id % 17 = 0 as pinned from documents where lang = 'en' and contains(lower(text), 'tion')",
    "flt05_top_items": "select doc_id, doc_id % 17 = 0 as pinned from documents order by pinned desc, doc_id desc limit 25",
    "flt08_under_folder": f"with {x.FILES_SQL} select doc_id, path from files where starts_with(path, 'src1/en/')",
    "flt13_secret_warning": "select doc_id, regexp_matches(text, '(?i)(api[_-]?key|secret|token|password)\\s*[:=]\\s*\\S+') or regexp_matches(text, '\\bsk-[A-Za-z0-9_-]{12,}') or regexp_matches(text, '-----BEGIN [A-Z ]*PRIVATE KEY-----') as warning from documents",
    "srt02_search_top": "select * from (select doc_id, cast((length(text) - length(replace(lower(text), 'the', ''))) // 3 + (length(text) - length(replace(lower(text), 'tion', ''))) // 4 as bigint) as score from documents) where score > 0 order by score desc, doc_id desc limit 50",
    "srt02_search_all": "select * from (select doc_id, cast((length(text) - length(replace(lower(text), 'the', ''))) // 3 + (length(text) - length(replace(lower(text), 'tion', ''))) // 4 as bigint) as score from documents) where score > 0",
    "set06_combined": "with u as (select *, sum(length(text)) over (partition by source order by doc_id) - length(text) as used from documents) select source as folder, cast(used // 100000 as bigint) as part, string_agg(text, chr(10) || '---' || chr(10) order by doc_id) as body from u group by 1, 2",
}
SQL["join17_enriched"] = (
    f"with nr as ({SQL['join17_nearest_names']}), it as (select name, case when doc_id % 4 = 0 then 'GN' else 'd' || (doc_id % 3) end as domain, ['t' || (doc_id % 5), 'u' || (doc_id % 2)] as tags from (with {x.FILES_SQL} select name, min(doc_id) as doc_id from files group by name)), nb as (select * from nr join it using (name) where similarity >= 0.05), "
    "dm as (select query, domain from (select query, domain, row_number() over (partition by query order by round(sum(similarity), 9) desc, domain) as nth from nb where domain <> 'GN' group by query, domain) where nth = 1), tg as (select query, string_agg(tag, ',' order by nth) as tags from (select query, tag, row_number() over (partition by query order by round(sum(similarity), 9) desc, tag) as nth from (select query, similarity, unnest(tags) as tag from nb) group by query, tag) where nth <= 3 group by query) "
    "select query, max(similarity) as best, coalesce(max(domain), 'GN') as domain, coalesce(max(tags), '') as tags, case when max(similarity) >= 0.6 then 'enriched' when max(similarity) >= 0.3 then 'compare' else 'uncertain' end as outcome from nr left join dm using (query) left join tg using (query) group by query"
)
