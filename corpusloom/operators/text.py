"""Lexicon-driven text scoring: terms are tables (category, term, weight, ..) that the caller replaces at will.

Terms are looked up as substrings or as whole words by `mode`; counts don't overlap. A lexicon is small: its size is
checked and it becomes one array of constants, so that a text is read once whatever the number of terms.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Most terms that a lexicon may have to be used as constants.
MOST_TERMS = 2000


def occurrences(text: Column, term: Column | str) -> Column:
    """Occurrences of a term in a text that don't overlap."""
    term = F.lit(term) if isinstance(term, str) else term
    return ((F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)).cast("bigint")


def constants(lexicon: list[tuple[str, str, float]]) -> Column:
    if len(lexicon) > MOST_TERMS:
        raise ValueError(f"{len(lexicon)} terms; join a table of words instead (see word_scores)")
    return F.array(*(F.struct(F.lit(c).alias("category"), F.lit(t).alias("term"), F.lit(float(w)).alias("weight")) for c, t, w in lexicon))


def term_counts(docs: DataFrame, lexicon: list[tuple[str, str, float]]) -> DataFrame:
    """(doc_id, category, term, weight, n) of the terms that occur, as substrings of the lower-cased text."""
    low = docs.select("doc_id", F.lower("text").alias("t"))
    hits = F.filter(F.transform(constants(lexicon), lambda x: F.struct(x["category"].alias("category"), x["term"].alias("term"), x["weight"].alias("weight"), occurrences(F.col("t"), x["term"]).alias("n"))), lambda x: x["n"] > 0)
    return low.select("doc_id", F.explode(hits).alias("x")).select("doc_id", "x.*")


def word_scores(docs: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(doc_id, category, n, score): words matched whole, by a join on the word; the lexicon may have any size."""
    words = docs.select("doc_id", F.explode(F.expr("regexp_extract_all(lower(text), '[a-z]+', 0)")).alias("term")).groupBy("doc_id", "term").count()
    return words.join(lexicon, "term").groupBy("doc_id", "category").agg(F.sum("count").alias("n"), F.sum(F.col("count") * F.col("weight")).alias("score"))


def profile(docs: DataFrame, lexicon: list[tuple[str, str, float]]) -> DataFrame:
    """(doc_id, category, score, percent): weighted counts by category, and their shares of the document's total."""
    s = term_counts(docs, lexicon).groupBy("doc_id", "category").agg(F.sum(F.col("n") * F.col("weight")).alias("score"))
    return s.withColumn("percent", F.round(100 * F.col("score") / F.sum("score").over(Window.partitionBy("doc_id")), 4))


def primary(scores: DataFrame, order: list[str]) -> DataFrame:
    """(doc_id, first, second, margin): the two largest categories; equals stand in the lexicon's order."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("category"))
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), place)
    ranked = scores.select("doc_id", "category", "score", F.row_number().over(w).alias("nth"), F.lead("category").over(w).alias("second"), F.lead("score").over(w).alias("next"))
    return ranked.where("nth = 1").select("doc_id", F.col("category").alias("first"), "second", (F.col("score") - F.coalesce("next", F.lit(0.0))).alias("margin"))


def gate(docs: DataFrame, lexicon: list[tuple[str, str, float]], regulated: list[str], margin: float = 0.6, least: float = 0.5) -> DataFrame:
    """(doc_id, category, per_1000, overridden): densest category; a regulated one close behind the top one wins."""
    words = docs.select("doc_id", F.greatest(F.lit(1), F.size(F.expr("regexp_extract_all(lower(text), '[a-z0-9]+', 0)"))).alias("words"))
    s = term_counts(docs, lexicon).groupBy("doc_id", "category").agg(F.sum("n").alias("n")).join(words, "doc_id").select("doc_id", "category", F.round(F.col("n") * 1000.0 / F.col("words"), 3).alias("d"))
    top = s.groupBy("doc_id").agg(F.max("d").alias("d0"), F.min_by("category", F.struct(-F.col("d"), F.col("category"))).alias("c0"), F.max(F.when(F.col("category").isin(regulated), F.col("d"))).alias("d1"), F.min_by(F.when(F.col("category").isin(regulated), F.col("category")), F.struct(F.when(F.col("category").isin(regulated), -F.col("d")).otherwise(F.lit(1e18)), F.col("category"))).alias("c1"))
    over = ~F.col("c0").isin(regulated) & F.coalesce(F.col("d1") >= F.col("d0") * margin, F.lit(False))
    out = top.select("doc_id", F.when(over, F.col("c1")).otherwise(F.col("c0")).alias("category"), F.when(over, F.col("d1")).otherwise(F.col("d0")).alias("per_1000"), over.alias("overridden"))
    return out.withColumn("category", F.when((F.col("per_1000") < least) & ~F.col("overridden"), "uncategorized").otherwise(F.col("category")))


#: The routes of work whose source is in part, or not, at hand.
SHALLOW = "process_shallow"


def gate_routes(gated: DataFrame, registry: DataFrame, other: str = "uncategorized") -> DataFrame:
    """(doc_id, category, overridden, tier, access, route, reason, sources) of gated texts.

    registry: (category, tier, access, sources, route_available, route_blocked); access is `have`, `partial` or
    `missing`. A category without an entry takes that of `other`.
    """
    has = registry.select("category").withColumn("known", F.lit(True))
    asked = gated.join(has, "category", "left").withColumn("entry", F.when(F.col("known"), F.col("category")).otherwise(other))
    df = asked.join(registry.withColumnRenamed("category", "entry"), "entry")
    access = F.col("access")
    route = F.when(access == "have", F.col("route_available")).when(access == "partial", SHALLOW).otherwise(F.col("route_blocked"))
    reason = F.when(access == "have", "required source available").when(access == "partial", "partial access, light work now and the rest later").otherwise("required source not configured")
    return df.select("doc_id", "category", "overridden", "tier", "access", route.alias("route"), reason.alias("reason"), "sources")


def access_report(routed: DataFrame, block: str) -> DataFrame:
    """(part, value, n): counts of routes, tiers and overrides, and for each blocked category and source how many texts wait for it."""
    one = lambda part, value, rows=routed: rows.groupBy(F.lit(part).alias("part"), value.alias("value")).agg(F.count("*").alias("n"))
    blocked = routed.where(F.col("route") == block)
    wanted = blocked.select("category", F.explode("sources").alias("source")).select(F.concat_ws(":", "category", "source").alias("value"))
    parts = [one("route", F.col("route")), one("tier", F.col("tier")), one("overridden", F.col("overridden").cast("string")), one("needs_access", F.col("value"), wanted)]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def intensity(docs: DataFrame, patterns: dict[str, dict[int, list[str]]]) -> DataFrame:
    """(doc_id, property, level): from 1 to 3 by the number of matching patterns of each tier."""
    def level(tiers: dict[int, list[str]]) -> Column:
        n = {k: sum((F.col("text").rlike(p).cast("int") for p in tiers.get(k, [])), F.lit(0)) for k in (3, 2, 1)}
        return F.when(n[3] >= 2, 3).when((n[3] >= 1) | (n[2] >= 2), 2).when((n[2] >= 1) | (n[1] >= 1), 1).otherwise(0)

    each = F.array(*(F.struct(F.lit(k).alias("property"), level(t).alias("level")) for k, t in patterns.items()))
    return docs.select("doc_id", F.explode(each).alias("x")).select("doc_id", "x.*").where("level > 0")


def frequent_terms(docs: DataFrame, stop: list[str], most: int = 3, least_length: int = 4) -> DataFrame:
    """(doc_id, terms): the most frequent words, by name among equals."""
    words = docs.select("doc_id", F.explode(F.expr(f"regexp_extract_all(lower(text), '[a-z]{{{least_length},}}', 0)")).alias("w")).where(~F.col("w").isin(stop)).groupBy("doc_id", "w").count()
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("count"), "w"))
    top = words.withColumn("nth", nth).where(F.col("nth") <= most)
    return top.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "w"))), lambda x: x["w"]), ",").alias("terms"))


def sentences(docs: DataFrame, least: int = 20) -> DataFrame:
    """(doc_id, nth, sentence): texts cut behind . ! ? before a capital or a digit; short pieces dropped, then numbered."""
    every = F.filter(F.transform(F.split(F.trim(F.regexp_replace("text", r"\s+", " ")), r"(?<=[.!?])\s+(?=[A-Z0-9])"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)
    return docs.select("doc_id", F.posexplode(every).alias("nth", "sentence"))


def paragraphs(docs: DataFrame, least: int = 4) -> DataFrame:
    """(doc_id, nth, n_words): paragraphs of at least `least` words."""
    every = F.filter(F.transform(F.split("text", r"\n"), lambda p: F.size(F.filter(F.split(p, " "), lambda w: w != ""))), lambda n: n >= least)
    return docs.select("doc_id", F.posexplode(every).alias("nth", "n_words"))


def spans(docs: DataFrame, terms: list[tuple[str, float]]) -> DataFrame:
    """(doc_id, term, start, end, contribution): every place of a lexicon's terms (term, weight) in the lower-cased text, from 0."""
    low = docs.select("doc_id", F.lower("text").alias("t"))
    each = F.explode(F.filter(F.array(*(F.struct(F.lit(x).alias("term"), F.lit(float(w)).alias("weight")) for x, w in terms)), lambda x: F.contains("t", x["term"])))
    rows = low.select("doc_id", "t", each.alias("x")).select("doc_id", "x.term", "x.weight", F.transform(F.split("t", F.concat(F.lit("\\Q"), "x.term", F.lit("\\E")), -1), lambda p: F.length(p)).alias("p"))
    ends = rows.select("doc_id", "term", "weight", F.posexplode("p").alias("i", "length"), F.size("p").alias("n"))
    w = Window.partitionBy("doc_id", "term").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    start = (F.sum("length").over(w) + F.col("i") * F.length("term")).cast("int")
    placed = ends.select("doc_id", "term", "weight", "i", "n", start.alias("start")).where("i < n - 1")
    return placed.select("doc_id", "term", "start", (F.col("start") + F.length("term")).alias("end"), F.col("weight").alias("contribution"))


def snippets(docs: DataFrame, keyword: str, width: int = 80, most: int = 3) -> DataFrame:
    """(doc_id, nth, snippet): the text around the first `most` places of a keyword (a report's feature)."""
    parts = F.transform(F.split(F.lower("text"), f"\\Q{keyword}\\E", most + 1), lambda p: F.length(p))
    starts = F.transform(F.slice("p", 1, F.size("p") - 1), lambda x, i: F.aggregate(F.slice("p", 1, i + 1), F.lit(0), lambda a, y: a + y) + i * len(keyword) + 1)
    rows = docs.where(F.contains(F.lower("text"), F.lit(keyword))).select("doc_id", "text", parts.alias("p")).select("doc_id", "text", F.posexplode(starts).alias("nth", "at"))
    first = F.greatest(F.lit(1), F.col("at") - width)
    return rows.select("doc_id", "nth", F.substring("text", first, F.col("at") - first + F.lit(len(keyword) + width)).alias("snippet"))


def simhash(docs: DataFrame) -> DataFrame:
    """(doc_id, simhash): 64 bits as text, the highest first; each word of 3 or more letters votes with its md5.

    Words vote where they are read: a document's votes are summed before anything travels, one row a document.
    """
    words = docs.select("doc_id", F.explode(F.expr("regexp_extract_all(lower(text), '[a-z0-9_]{3,}', 0)")).alias("w"))
    half = lambda at: F.conv(F.substring(F.md5(F.col("w").cast("binary")), at, 8), 16, 10).cast("bigint")
    votes = words.select("doc_id", half(17).alias("hi"), half(25).alias("lo"))
    vote = lambda i: F.when(F.shiftright("hi" if i < 32 else "lo", 31 - i % 32).bitwiseAND(1) == 1, 1).otherwise(-1)
    sums = votes.groupBy("doc_id").agg(*(F.sum(vote(i)).alias(f"v{i}") for i in range(64)))
    return sums.select("doc_id", F.concat(*(F.when(F.col(f"v{i}") > 0, "1").otherwise("0") for i in range(64))).alias("simhash"))


def sections(docs: DataFrame, heading: str = r"^(#{1,6}\s|[A-Z]\w*\.$)") -> DataFrame:
    """(doc_id, section, nth, line): lines with the running number of their section; a heading begins one, lines before the first are section 0."""
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("nth", "line"))
    return lines.select("doc_id", F.count_if(F.col("line").rlike(heading)).over(Window.partitionBy("doc_id").orderBy("nth")).alias("section"), "nth", "line")


def section_hashes(docs: DataFrame, heading: str = r"^(#{1,6}\s|[A-Z]\w*\.$)") -> DataFrame:
    """(doc_id, level, section, hash): a tree of hashes: of each section's trimmed lines (level 1), and of those hashes (level 0, section null)."""
    plain = F.lower(F.trim(F.regexp_replace("line", r"\s+", " ")))
    kept = sections(docs, heading).where(F.trim("line") != "").select("doc_id", "section", "nth", plain.alias("x"))
    ordered = lambda c, at: F.transform(F.array_sort(F.collect_list(F.struct(at, c))), lambda x: x[c])
    leaves = kept.groupBy("doc_id", "section").agg(F.sha2(F.array_join(ordered("x", "nth"), "\n").cast("binary"), 256).alias("hash"))
    roots = leaves.groupBy("doc_id").agg(F.sha2(F.array_join(ordered("hash", "section"), "|").cast("binary"), 256).alias("hash"))
    return leaves.select("doc_id", F.lit(1).alias("level"), "section", "hash").unionByName(roots.select("doc_id", F.lit(0).alias("level"), F.lit(None).cast("bigint").alias("section"), "hash"))


def stage_balance(docs: DataFrame, good: list[str], bad: list[str]) -> DataFrame:
    """(doc_id, good, bad, balance): different words of two lists in the text."""
    words = F.expr("regexp_extract_all(lower(text), '[a-z]{2,}', 0)")
    n = lambda terms: F.size(F.array_intersect(words, F.array(*map(F.lit, terms))))
    return docs.select("doc_id", n(good).alias("good"), n(bad).alias("bad")).withColumn("balance", F.when(F.col("good") > F.col("bad"), "positive").when(F.col("good") < F.col("bad"), "negative").otherwise("even"))
