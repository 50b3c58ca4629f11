"""Classification of files by name, type and age; review gates; rule tables; semantic addresses.

Word lists and maps are parameters with the defaults below.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Content types by extension, words of lifecycle states, and words that block or need review.
TYPES = {
    "document": [".md", ".pdf", ".doc", ".docx", ".html", ".htm", ".rtf"], "note": [".txt"], "code": [".py", ".js", ".ts", ".ahk", ".sh", ".ps1", ".bat", ".java", ".c", ".cpp"],
    "data": [".csv", ".json", ".xlsx", ".xls", ".db", ".sqlite", ".parquet"], "config": [".yaml", ".yml", ".toml", ".ini", ".cfg"], "image": [".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".bmp", ".tiff"],
    "video": [".mp4", ".mov", ".mkv", ".avi"], "audio": [".mp3", ".wav", ".flac", ".m4a"],
}
PAPER = "abstract|references|doi:|et al|we show that"
STATES = {"draft": "draft|wip|temp|tmp|working|scratch", "final": "final|done|complete|publish|release", "archive": "archive|old|backup|bak|_old|deprecated", "review": "review|check|todo|pending|flag"}
SECRET_NAME = "secret|password|credential|token|\\.env"
RISKY = [".exe", ".dll", ".sh", ".bat", ".cmd", ".ps1"]
#: Fixed value: the confidence from which a rename needs no review.
SURE = 0.98
JUNK_WORDS = r"(?i)\b(v\d+|final|copy|old|new|temp|tmp|test|draft|bak|backup|untitled|document|file|data|the|and|for|with|from|this|that)\b"
ALPHABET = "0123456789ABCDEFGHJKMNPQRSTVWXYZ"


def content_type(files: DataFrame) -> DataFrame:
    """(doc_id, content_type): by extension; documents with the words of a paper are papers, unknown texts notes."""
    kind = F.when(F.col("content") != "", "note").otherwise("binary")
    for k, exts in TYPES.items():
        kind = F.when(F.col("ext").isin(exts), k).otherwise(kind)
    kind = F.when(F.col("ext").isin(TYPES["document"]) & F.lower("content").rlike(PAPER), "paper").otherwise(kind)
    return files.select("doc_id", kind.alias("content_type"))


def lifecycle(files: DataFrame, as_of: int, old: int = 180) -> DataFrame:
    """(doc_id, state): by words of the name, in the order of STATES, else by age."""
    state = F.when(as_of - F.col("day") > old, "archive").otherwise("active")
    for k in reversed(STATES):
        state = F.when(F.lower("name").rlike(STATES[k]), k).otherwise(state)
    return files.select("doc_id", state.alias("state"))


def blocked(files: DataFrame, protected: list[str], roots: DataFrame, profiles: DataFrame | None = None) -> DataFrame:
    """(doc_id, reason): why a file must not be touched; roots are folders (root, dir) of programs, profiles those of roots (root, protected)."""
    marked = roots.select("root", "dir").distinct().withColumn("is_root", F.lit(True))
    guarded = (profiles if profiles is not None else files.select("root", F.lit(False).alias("protected")).limit(0)).groupBy("root").agg(F.bool_or("protected").alias("guarded"))
    reason = F.when(F.col("guarded"), "protected_folder_profile").when(F.arrays_overlap(F.split("dir", "/"), F.array(*map(F.lit, protected))), "protected_directory").when(F.lower("name").rlike(SECRET_NAME), "secret_or_credential_name").when(F.col("is_root"), "program_root")
    return files.join(marked, ["root", "dir"], "left").join(guarded, "root", "left").select("doc_id", reason.alias("reason")).where("reason is not null")


def review_gate(suggestions: DataFrame, inventory: DataFrame, threshold: float = SURE, risky: list[str] | None = None) -> DataFrame:
    """(doc_id, review, reason) of rename suggestions (doc_id, path, target, ext, confidence, protected, review_only, least).

    The last three come from the folder's profile and may be null; least is the profile's own threshold.
    """
    taken = inventory.select(F.col("path").alias("target")).distinct().withColumn("taken", F.lit(True))
    low = F.col("confidence") < F.coalesce("least", F.lit(threshold))
    reason = F.when(F.col("protected"), "protected_folder").when(F.col("review_only"), "folder_review_only").when(F.lower("ext").isin(risky or RISKY), "risky_file_type").when(F.col("taken"), "target_exists").when(low, "low_confidence").otherwise("auto_approved_threshold")
    return suggestions.join(taken, "target", "left").select("doc_id", (reason != "auto_approved_threshold").alias("review"), reason.alias("reason"))


def matching_rule(files: DataFrame, rules: list[tuple[str, str, int]]) -> DataFrame:
    """(doc_id, destination): of the glob rules (pattern, destination, hits) that match the path, the most used; equals by pattern."""
    import fnmatch

    ordered = sorted(rules, key=lambda r: (-r[2], r[0]))
    if len(ordered) > 500:
        raise ValueError("more than 500 glob rules; join on an extension or prefix first")
    dest = F.lit(None).cast("string")
    for pattern, destination, _ in reversed(ordered):
        # Python closes a glob with \z or \Z; Java's whole-match anchors are plain
        dest = F.when(F.lower("path").rlike("^" + fnmatch.translate(pattern.lower()).removesuffix(r"\z").removesuffix(r"\Z") + "$"), destination).otherwise(dest)
    return files.select("doc_id", dest.alias("destination")).where("destination is not null")


def slug(files: DataFrame, most: int = 4) -> DataFrame:
    """(doc_id, slug): up to `most` words of the name, without filler words."""
    words = F.slice(F.filter(F.split(F.trim(F.regexp_replace("stem", JUNK_WORDS, "")), r"[_\-\s]+"), lambda w: F.length(w) > 2), 1, most)
    return files.select("doc_id", F.when(F.size(words) == 0, "untitled").otherwise(F.lower(F.array_join(words, "-"))).alias("slug"))


def tags(docs: DataFrame, groups: list[tuple[list[str], str]], most: int = 3) -> DataFrame:
    """(doc_id, tags): codes of the first groups with a keyword in the text, in the groups' order."""
    low = F.lower("text")
    hit = lambda words: sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0)) > 0
    found = F.slice(F.array_compact(F.array(*(F.when(hit(w), F.lit(c)) for w, c in groups))), 1, most)
    return docs.select("doc_id", F.array_join(found, ",").alias("tags"))


def layered(paths: DataFrame, markers: DataFrame, profiles: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """The settings of each (key): a marker's value, else the profile's, else the default."""
    cols = list(defaults)
    m = markers.select("key", *(F.col(c).alias(f"_m_{c}") for c in cols))
    p = profiles.select("key", *(F.col(c).alias(f"_p_{c}") for c in cols))
    df = paths.join(m, "key", "left").join(p, "key", "left")
    return df.select("key", *(F.coalesce(f"_m_{c}", f"_p_{c}", F.lit(defaults[c])).alias(c) for c in cols))


def first_rule(rows: DataFrame, rules: DataFrame, key: str, values: list[str]) -> DataFrame:
    """(key, axis, output): of each axis the rule of least priority whose minima (null: any) the values reach.

    rules: (axis, priority, output, min_<value>..); a rule table is small, and its join is by comparison alone.
    """
    met = [F.col(f"min_{v}").isNull() | (F.col(v) >= F.col(f"min_{v}")) for v in values]
    on = met[0]
    for m in met[1:]:
        on = on & m
    return rows.join(F.broadcast(rules), on).groupBy(key, "axis").agg(F.min_by("output", "priority").alias("output"))


def quantised(score: Column) -> Column:
    """0 to 3 in 2 bits."""
    return F.when(score < 0.75, 0).when(score < 1.5, 1).when(score < 2.25, 2).otherwise(3)


def address(vectors: DataFrame, column: str = "v") -> DataFrame:
    """Adds `code`: 10 scores from 0 to 3 packed to 20 bits and written as 4 letters of base 32."""
    bits = F.aggregate(F.transform(column, quantised), F.lit(0), lambda a, q: F.shiftleft(a, 2).bitwiseOR(q))
    letter = lambda i: F.substring(F.lit(ALPHABET), F.shiftright(F.col("_bits"), 15 - i * 5).bitwiseAND(31) + 1, F.lit(1))
    return vectors.withColumn("_bits", bits).withColumn("code", F.concat(*(letter(i) for i in range(4)))).drop("_bits")


def decoded(codes: DataFrame, column: str = "code") -> DataFrame:
    """Adds `levels`: the ten levels of a code."""
    five = F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.position(F.substring(F.col(column), i, F.lit(1)), F.lit(ALPHABET)) - 1)
    packed = F.aggregate(five, F.lit(0), lambda a, x: F.shiftleft(a, 5).bitwiseOR(x))
    return codes.withColumn("_p", packed).withColumn("levels", F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: F.call_function("shiftright", F.col("_p"), (18 - 2 * i).cast("int")).bitwiseAND(3))).drop("_p")


def resolution(files: DataFrame) -> DataFrame:
    """(doc_id, state): identical, conflicting, original, derived or unique, from counts of contents and names."""
    by_hash = files.groupBy("root", "hash").agg(F.count("*").alias("same"))
    by_name = files.groupBy("root", F.lower("name").alias("low")).agg(F.countDistinct("hash").alias("contents"))
    df = files.withColumn("low", F.lower("name")).join(by_hash, ["root", "hash"]).join(by_name, ["root", "low"])
    state = F.when(F.col("same") > 1, "IDENTICAL").when(F.col("contents") > 1, "CONTENT_CONFLICT").when(F.lower("path").rlike("signed|legal|original"), "PROTECTED_ORIGINAL").when(F.col("ext").isin(".html", ".pdf", ".docx"), "DERIVED_OUTPUT").otherwise("UNIQUE_ADDITION")
    return df.select("doc_id", state.alias("state"))


def group_scores(files: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(source, target, raw, margin): the best target group of each source group, and its lead over the next.

    Groups are folders; names, extensions and contents are compared as sets. Folders meet by their names and contents.
    Extensions are few and in every folder, so folders don't meet by them: the different sets of extensions are
    compared with each other, and each set gets the three first folders of those nearest to it. A folder's two best
    targets are among these and those that it shares a name or a content with, as any other has the nearest ones' score
    at most.
    """
    items = {"names": files.select("dir", F.lower("name").alias("e")).distinct(), "hashes": files.select("dir", F.col("hash").alias("e")).distinct()}
    kinds = files.groupBy("dir").agg(F.array_sort(F.collect_set("ext")).alias("exts"))  # a folder has few extensions
    parts = None
    for part, e in items.items():
        n = e.groupBy("dir").agg(F.count("*").alias("n"))
        both = e.alias("a").join(e.alias("b"), F.expr("a.e = b.e and a.dir <> b.dir")).groupBy(F.col("a.dir").alias("source"), F.col("b.dir").alias("target")).agg(F.count("*").alias("c"))
        j = both.join(n.withColumnsRenamed({"dir": "source", "n": "ns"}), "source").join(n.withColumnsRenamed({"dir": "target", "n": "nt"}), "target")
        one = j.select("source", "target", (weights[part] * F.col("c") / (F.col("ns") + F.col("nt") - F.col("c"))).alias("v"))
        parts = one if parts is None else parts.unionByName(one)
    shared = parts.groupBy("source", "target").agg(F.sum("v").alias("v"))
    # the three first folders of each set of extensions, taken part by part
    first = lambda df, *by: df.withColumn("nth", F.row_number().over(Window.partitionBy("exts", *by).orderBy("dir"))).where("nth <= 3").drop("nth")
    heads = first(first(kinds.withColumn("part", F.pmod(F.xxhash64("dir"), F.lit(64))), "part").drop("part"))
    sets = kinds.select("exts").distinct()
    elements = sets.select("exts", F.explode("exts").alias("e"))
    near = elements.alias("a").join(elements.alias("b"), F.expr("a.e = b.e")).select(F.col("a.exts").alias("exts"), F.col("b.exts").alias("other")).distinct()
    alike = lambda p, q: F.size(F.array_intersect(p, q)) / F.size(F.array_union(p, q))
    near = near.join(heads.withColumnRenamed("exts", "other"), "other").withColumn("j", alike("exts", "other"))
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("exts").orderBy(F.desc("j"), "dir"))).where("nth <= 3").select("exts", F.col("dir").alias("target"))
    by_ext = kinds.join(near, "exts").select(F.col("dir").alias("source"), "target").where("source <> target")
    pairs = shared.unionByName(by_ext.withColumn("v", F.lit(0.0))).groupBy("source", "target").agg(F.sum("v").alias("v"))
    side = lambda c: kinds.select(F.col("dir").alias(c), F.col("exts").alias(f"{c}_exts"))
    raw = pairs.join(side("source"), "source").join(side("target"), "target").select("source", "target", F.round(F.col("v") + weights["exts"] * alike("source_exts", "target_exts"), 9).alias("raw")).where("raw > 0")
    w = Window.partitionBy("source").orderBy(F.desc("raw"), "target")
    ranked = raw.withColumns({"nth": F.row_number().over(w), "next": F.lead("raw").over(w)})
    return ranked.where("nth = 1").select("source", "target", F.round("raw", 6).alias("raw"), F.round(F.when(F.col("next").isNull(), 1.0).otherwise((F.col("raw") - F.col("next")) / F.greatest(F.lit(1.0), F.col("raw"))), 6).alias("margin"))


def cooccurrence(words: DataFrame, least: int = 2) -> DataFrame:
    """(a, b, n): pairs of terms of one document (doc_id, term), and in how many they are; terms are a bounded list."""
    one = words.select("doc_id", "term").distinct()
    return one.alias("x").join(one.alias("y"), F.expr("x.doc_id = y.doc_id and x.term < y.term")).groupBy(F.col("x.term").alias("a"), F.col("y.term").alias("b")).agg(F.count("*").alias("n")).where(F.col("n") >= least)
