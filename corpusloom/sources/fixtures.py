"""The supplied tables in the shapes that the operators take.

Each adapter has a DataFrame form and the SQL of the same rows, built from the same expressions, which both engines
read alike. Names, folders and times follow from the document ids, so that every kind of finding occurs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators.encodings import encoding


def pick(key: str, values: list[str], other: str = "''") -> str:
    """SQL: the value at the place that key gives, else `other`."""
    return f"case {key} " + " ".join(f"when {i} then '{v}'" for i, v in enumerate(values)) + f" else {other} end"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


EXTS = [".md", ".txt", ".pdf", ".docx", ".html", ".py", ".png", ".zip", ".log", ".json", ".jpg", ".xlsx", ".exe", ".lnk", ".chi", ".srt", ".yml", "", ".odd", ".csv"]
STEMS = ["readme", "IMG_1234", "draft notes", "chatgpt transcript", "Invoice may", "Untitled 3", "x sync-conflict y", "requirements", "package", "claude plan", "gpt plan", "config"]
FOLDERS = ["/a/b/c/d/e", "/research", "/build", "/output", "/.git", "/tmp"]
_ext = pick("doc_id div 7 % 20", EXTS)
_stem = pick("doc_id div 3 % 31", STEMS, "'doc_' || cast(doc_id % 40 as string) || " + pick("doc_id % 7", ["_v2", "_final", " (1)"]))
_dir = "source || '/' || lang || " + pick("doc_id % 37", FOLDERS)
#: Rows that show rare symptoms, by doc_id % 200: folder, stem, extension; every fourth file lies in one large folder.
RARE = {
    101: ("src1/pa/app", "readme", ".md"), 102: ("src1/pb/app", "readme", ".md"), 103: ("src1/pc/app", "readme", ".md"), 105: ("src1/links", "index", ".md"), 106: ("src1/pa", "app", ".zip"),
    107: ("src1/enc", "odd", ".txt"), 109: ("src1/leak", "", ".env"), 110: ("src1/" + "long" * 60, "deep", ".txt"), 111: ("src1/enc", "even", ".txt"), 113: ("src1/research", "Invoice may", ".pdf"), 114: ("src1/subs", "alone.meta", ".srt"), 115: ("src1/old", "readme", ".md"),
}


def _rare(place: int, other: str) -> str:
    return "case doc_id % 200 " + " ".join(f"when {k} then '{v[place]}'" for k, v in RARE.items()) + f" else {other} end"


FILES = {
    "doc_id": "doc_id", "root": "case when doc_id % 4 = 0 then 'src0' else " + "case when doc_id % 200 in (" + ", ".join(map(str, RARE)) + ") then 'src1' else source end end", "dir": f"case when doc_id % 4 = 0 then 'src0/all' else {_rare(0, _dir)} end", "stem": _rare(1, _stem), "ext": _rare(2, _ext),
    "size": "case when doc_id % 13 = 0 then n_chars % 90 else n_chars end", "day": "case when doc_id % 8 = 0 then 77 when doc_id % 200 = 115 then 1 else (doc_id % 1000) * 7 div 24 end", "hour": "case when doc_id % 8 = 0 then 77 * 24 + doc_id % 24 when doc_id % 200 = 115 then 24 else (doc_id % 1000) * 7 end", "lang": "lang",
    "content": "case doc_id % 200 when 105 then text || ' [[Missing Page]] [x](gone.md)' else text end",
}
#: The bytes of some files, as Latin-1.
LATIN = "Café au lait, s'il vous plaît"
#: The day (from the first) on which ages are taken.
AS_OF = 300


def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, root, dir, depth, name, stem, ext, path, size, hash, day and hour of the last change, content, encoding."""
    df = table(spark, sf_dir, "documents").select(*(F.expr(e).alias(c) for c, e in FILES.items()))
    raw = F.when(F.expr("doc_id % 200 = 107"), F.encode(F.lit(LATIN), "ISO-8859-1")).otherwise(F.col("content").cast("binary"))
    return df.withColumns({"name": F.concat("stem", "ext"), "path": F.concat("dir", F.lit("/"), "stem", "ext"), "hash": F.sha2("content", 256), "depth": F.size(F.split("dir", "/")), "encoding": encoding(raw)})


def dirs(files: DataFrame) -> DataFrame:
    """root, dir, parent, base, day: every folder above a file, with its latest change, and a few empty ones."""
    parts = F.split("dir", "/")
    places = files.select("root", "day", "dir").unionByName(files.where("doc_id % 200 = 111").select("root", "day", F.concat("dir", F.lit("/empty")).alias("dir")))
    every = places.select("root", "day", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))).alias("dir"))
    return every.groupBy("root", "dir").agg(F.max("day").alias("day")).withColumns({"base": F.substring_index("dir", "/", -1), "parent": F.expr("case when instr(dir, '/') > 0 then substring(dir, 1, length(dir) - length(substring_index(dir, '/', -1)) - 1) end")})


FILES_SQL = "files as (select *, case when doc_id % 200 = 107 then 'ISO-8859-1' when content = '' then 'EMPTY' when regexp_full_match(content, '[\\x00-\\x7f]*') then 'ASCII' when content is not null then 'UTF-8' end as encoding, stem || ext as name, dir || '/' || stem || ext as path, sha256(content) as hash, len(string_split(dir, '/')) as depth from (select " + ", ".join(f"{e.replace(' div ', ' // ')} as {c}" for c, e in FILES.items()) + " from documents))"
DIRS_SQL = FILES_SQL + """, dirs as (select root, dir, max(day) as day, list_last(string_split(dir, '/')) as base, case when dir like '%/%' then regexp_replace(dir, '/[^/]*$', '') end as parent
from (select root, day, unnest(list_transform(generate_series(1, len(string_split(dir, '/'))), lambda i: array_to_string(string_split(dir, '/')[1:i], '/'))) as dir from (select root, day, dir from files union all select root, day, dir || '/empty' from files where doc_id % 200 = 111)) group by root, dir)"""


def files_before(files: DataFrame) -> DataFrame:
    """An earlier snapshot: some files absent, some changed since, some in another folder."""
    return files.where("doc_id % 5 <> 0").withColumns({"hour": F.expr("case when doc_id % 11 = 0 then hour - 5 else hour end"), "dir": F.expr("case when doc_id % 13 = 0 then dir || '/old' else dir end")}).withColumn("path", F.concat("dir", F.lit("/"), "name"))


BEFORE_SQL = FILES_SQL + ", before as (select * exclude (path), dir || '/' || name as path from (select * replace (case when doc_id % 11 = 0 then hour - 5 else hour end as hour, case when doc_id % 13 = 0 then dir || '/old' else dir end as dir) from files where doc_id % 5 <> 0))"

#: Events as observations of files being moved: k is the number in props.
KIND = pick("k % 6", ["pdf", "md", "png", "docx", "txt", "zip"])
OBSERVATIONS = {"event_id": "event_id", "ext": "'.' || " + KIND, "dest": "'lib' || cast(user_id % 8 as string)", "folder": "'in' || cast(user_id % 5 as string)", "hour": "cast(hour(ts) as int)", "ts": "ts", "name": "case when k % 3 = 0 then 'Scan_' || cast(k as string) when k % 3 = 1 then 'report-2024-01-' || cast(10 + k % 19 as string) else 'note ' || cast(k as string) end"}


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files moved: extension, destination, folder, hour and time."""
    events = table(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    return events.select(*(F.expr(e).alias(c) for c, e in OBSERVATIONS.items()))


OBSERVATIONS_SQL = "observations as (select " + ", ".join(f"{e} as {c}" for c, e in OBSERVATIONS.items()) + " from (select *, cast(json_extract_string(props, '$.k') as int) as k from events))"

EVENT_KIND = "case event_type when 'signup' then 'created' when 'purchase' then 'moved' when 'error' then 'deleted' else 'modified' end"


def file_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, kind, path, ts."""
    return table(spark, sf_dir, "events").select("event_id", F.expr(EVENT_KIND).alias("kind"), F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/f"), F.coalesce(F.get_json_object("props", "$.k"), F.lit("x"))).alias("path"), F.col("ts").cast("timestamp").alias("ts"))


FILE_EVENTS_SQL = f"file_events as (select event_id, {EVENT_KIND} as kind, 'u' || cast(user_id as string) || '/f' || coalesce(json_extract_string(props, '$.k'), 'x') as path, ts from events)"

#: Sentences that some texts get at their end, by doc_id % 16, so that every verdict on texts occurs.
PLANTED = [
    "Data shows and evidence measured it, so the source and a citation were reported.", "The mechanism is a process because the model leads to a proof.", "Ultimately the meaning and the sacred purpose of grace is good.", "Data observed by the source means that grace and the sacred should count.",
    "God intended the meaning of data and evidence from a source, reported and observed.", "The mechanism and model of a divine purpose, sacred and holy.", "The process and the structure of a divine purpose, sacred and holy.", "Accountability, consequence, judgment, restitution, boundary, violation and debt are due.",
    "Forgiveness, patience, compassion, dignity, healing and reconciliation are there.", "Accountability, consequence, judgment and violation meet forgiveness, patience, dignity and healing.", "Accountability, consequence, judgment and debt meet mercy, patience, dignity and healing, to pay the cost and sacrifice a price.",
    "They coerce, dominate, manipulate and blame.", "It proves what is undeniable and impossible.", "It proves one citation.", "Empirical statistical replication of the sample figure and table.", "",
]
_plant = "case doc_id % 16 " + " ".join(f"when {i} then '{t}'" for i, t in enumerate(PLANTED)) + " end"
PLANTED_TEXT = f"coalesce(text, '') || '. ' || {_plant}"


def planted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with a sentence of PLANTED at the end of their texts."""
    return table(spark, sf_dir, "documents").withColumn("text", F.expr(PLANTED_TEXT))


PLANTED_SQL = f"planted as (select * replace ({PLANTED_TEXT} as text) from documents)"
