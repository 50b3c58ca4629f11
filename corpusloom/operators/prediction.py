"""Predictions from behaviour: recency-weighted votes, rules, smoothed rates and Markov chains.

Ages are taken at `as_of`. Every choice of a best value has a stated order for ties.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The signals' weights.
SIGNALS = {"destination": 0.35, "naming": 0.25, "temporal": 0.15, "affinity": 0.15, "together": 0.10}


def recency(ts: Column, as_of: str, halflife: float = 30.0) -> Column:
    """Half after `halflife` days."""
    age = (F.unix_timestamp(F.lit(as_of).cast("timestamp")) - F.unix_timestamp(ts)) / 86400
    return F.exp(-F.log(F.lit(2.0)) * age / halflife)


def recent(observations: DataFrame, key: list[str], n: int) -> DataFrame:
    """The n latest observations of each key."""
    w = Window.partitionBy(*key).orderBy(F.desc("ts"), F.desc("event_id"))
    return observations.withColumn("_nth", F.row_number().over(w)).where(F.col("_nth") <= n).drop("_nth")


def votes(observations: DataFrame, key: list[str], as_of: str) -> DataFrame:
    """(key.., dest, vote): each destination's share of the recency weights."""
    sums = observations.groupBy(*key, "dest").agg(F.sum(recency(F.col("ts"), as_of)).alias("s"))
    return sums.withColumn("vote", F.col("s") / F.sum("s").over(Window.partitionBy(*key))).drop("s")


def best(votes: DataFrame, key: list[str], by: str = "vote") -> DataFrame:
    """The destination with the largest vote, by name among equals."""
    w = Window.partitionBy(*key).orderBy(F.desc(F.round(by, 9)), "dest")
    return votes.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def destination(observations: DataFrame, as_of: str, n: int = 100) -> DataFrame:
    return best(votes(recent(observations, ["ext"], n), ["ext"], as_of), ["ext"])


def temporal(observations: DataFrame, as_of: str, hour: int, width: int = 2, n: int = 200) -> DataFrame:
    """Votes of observations within `width` hours of the hour; midnight and unknown hours count as noon."""
    at = F.when(F.coalesce("hour", F.lit(0)) == 0, 12).otherwise(F.col("hour"))
    near = recent(observations, ["ext"], n).where(F.abs(at - hour) <= width)
    return best(votes(near, ["ext"], as_of), ["ext"]).withColumn("vote", F.col("vote") * 0.7)


def affinity(observations: DataFrame, as_of: str, n: int = 200) -> DataFrame:
    """(ext, folder, dest, vote): where files of a folder went."""
    return best(votes(recent(observations, ["ext"], n), ["ext", "folder"], as_of), ["ext", "folder"])


def together(observations: DataFrame, n: int = 500, seconds: int = 60, group: str = "folder") -> DataFrame:
    """(ext, partner, n): extensions that follow one another within `seconds` in a folder, both ways."""
    w = Window.partitionBy(group).orderBy("ts", "event_id")
    pairs = recent(observations, [group], n).select("ext", F.lead("ext").over(w).alias("partner"), (F.unix_timestamp(F.lead("ts").over(w)) - F.unix_timestamp("ts")).alias("apart")).where((F.col("apart") < seconds) & (F.col("ext") != F.col("partner")))
    return pairs.select("ext", "partner").unionByName(pairs.select(F.col("partner").alias("ext"), F.col("ext").alias("partner"))).groupBy("ext", "partner").agg(F.count("*").alias("n"))


def companions(observations: DataFrame, n: int = 500, seconds: int = 60, least: int = 3) -> DataFrame:
    """(ext, dest, vote): where the files go that most often move together with an extension, among the n latest moves of all."""
    last = observations.orderBy(F.desc("ts"), F.desc("event_id")).limit(n)
    pairs = together(last.withColumn("every", F.lit(1)), n, seconds, "every").where(F.col("n") >= least)
    partner = pairs.groupBy("ext").agg(F.max_by("partner", F.struct("n", "partner")).alias("partner"), F.max("n").alias("n"))
    went = last.where("dest is not null").groupBy(F.col("ext").alias("partner"), "dest").agg(F.count("*").alias("c")).groupBy("partner").agg(F.max_by("dest", F.struct("c", "dest")).alias("dest"))
    return partner.join(went, "partner").select("ext", "dest", F.least(F.lit(1.0), F.col("n") / 10).alias("vote"))


def combine(observations: DataFrame, as_of: str, hour: int, rules: DataFrame | None = None, others: int = 3) -> DataFrame:
    """(ext, folder, dest, confidence, naming, alternatives, ruled): weighted votes of all five signals.

    Destination, time, folder and companions vote for places, damped by the number of observations; names add a
    strength of their own. A permanent rule (ext, dest, hits), the most used first, wins with a confidence of 1.
    """
    places = observations.select("ext", "folder").distinct()
    moved = recent(observations, ["ext"], 200).select("ext", F.col("folder").alias("from"), "dest", "ts")
    there = places.join(moved, "ext").where(F.col("folder").startswith(F.col("from")))
    parts = [
        ("destination", places.join(destination(observations, as_of), "ext")), ("temporal", places.join(temporal(observations, as_of, hour), "ext")),
        ("affinity", best(votes(there, ["ext", "folder"], as_of), ["ext", "folder"])), ("together", places.join(companions(observations), "ext")),
    ]
    every = None
    for name, df in parts:
        one = df.select("ext", "folder", "dest", (F.col("vote") * SIGNALS[name]).alias("v"))
        every = one if every is None else every.unionByName(one)
    sums = every.groupBy("ext", "folder", "dest").agg(F.round(F.sum("v"), 9).alias("vote"))
    nth = F.row_number().over(Window.partitionBy("ext", "folder").orderBy(F.desc("vote"), "dest"))
    ranked = sums.withColumn("nth", nth).where(F.col("nth") <= others + 1)
    rest = F.array_sort(F.collect_list(F.when(F.col("nth") > 1, F.struct("nth", "dest", "vote"))))
    top = ranked.groupBy("ext", "folder").agg(F.max(F.when(F.col("nth") == 1, F.col("dest"))).alias("dest"), F.max("vote").alias("vote"), F.array_join(F.transform(rest, lambda x: F.concat_ws("=", x["dest"], F.format_number(x["vote"], 3))), ",").alias("alternatives"))
    total = observations.agg(F.least(F.lit(1.0), F.count("*") / 100).alias("damp"))
    seen = recent(observations, ["ext"], 100).groupBy("ext").agg(F.count("name").alias("names"))
    strength = F.when(F.col("names") >= 5, F.least(F.lit(1.0), F.col("names") / 20)).otherwise(0.0) * SIGNALS["naming"]
    out = top.crossJoin(F.broadcast(total)).join(seen, "ext", "left").select("ext", "folder", "dest", F.least(F.lit(0.99), F.col("vote") * F.col("damp")).alias("confidence"), F.round(strength, 6).alias("naming"), "alternatives")
    if rules is None:
        return out.withColumn("ruled", F.lit(False))
    rule = rules.groupBy("ext").agg(F.max_by("dest", F.struct("hits", "dest")).alias("to"))
    ruled = F.col("to").isNotNull()
    out = out.join(rule, "ext", "left")
    return out.select("ext", "folder", F.coalesce("to", "dest").alias("dest"), F.when(ruled, 1.0).otherwise(F.col("confidence")).alias("confidence"), F.when(ruled, 0.0).otherwise(F.col("naming")).alias("naming"), F.when(ruled, "").otherwise(F.col("alternatives")).alias("alternatives"), ruled.alias("ruled"))


def promoted(predictions: DataFrame, rules: DataFrame) -> DataFrame:
    """(pattern, dest, hits): the rules, and confirmed predictions (ext, dest, confirmed) that no rule covers yet, as `*ext`."""
    sure = predictions.where("confirmed").groupBy("ext").agg(F.max_by("dest", F.struct("confidence", "dest")).alias("dest")).select(F.concat(F.lit("*"), "ext").alias("pattern"), "dest", F.lit(0).cast("bigint").alias("hits"))
    return rules.select("pattern", "dest", "hits").unionByName(sure.join(rules, "pattern", "left_anti"))


def resolved(predictions: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """The predictions (key.., dest, name) with `correct`: whether what happened (key.., dest, name) agrees, where both are known."""
    plain = lambda c: F.lower(F.rtrim(F.replace(F.trim(c), F.lit("\\"), F.lit("/")), F.lit("/")))
    df = predictions.join(actual.withColumnsRenamed({"dest": "actual_dest", "name": "actual_name"}), key)
    place = F.coalesce(plain(F.col("actual_dest")) == plain(F.col("dest")), F.lit(True))
    name = F.coalesce(F.lower("actual_name") == F.lower("name"), F.lit(True))
    return df.withColumn("correct", place & name)


def naming(observations: DataFrame, n: int = 100) -> DataFrame:
    """(ext, n, underscores, hyphens, dates): habits in the names of each extension's latest files."""
    dated = F.col("name").rlike(r"\d{4}-\d{2}-\d{2}|\d{4}_\d{2}_\d{2}|\d{8}|\d{2}-\d{2}-\d{4}")
    return recent(observations, ["ext"], n).groupBy("ext").agg(F.count("*").alias("n"), F.count_if(F.contains("name", F.lit("_"))).alias("underscores"), F.count_if(F.contains("name", F.lit("-"))).alias("hyphens"), F.count_if(dated).alias("dates"))


def smoothed_rates(decisions: DataFrame, key: list[str], smooth: float = 2.0) -> DataFrame:
    """(key.., n, rate): approvals as a share, drawn towards one half."""
    return decisions.groupBy(*key).agg(F.count("*").alias("n"), F.sum("approved").alias("a")).select(*key, "n", ((F.col("a") + smooth * 0.5) / (F.col("n") + smooth)).alias("rate"))


def transitions(sequences: DataFrame, state: str, key: list[str], order: list[str]) -> DataFrame:
    """(state, after, n, share): how often a state follows another within a key."""
    w = Window.partitionBy(*key).orderBy(*order)
    pairs = sequences.select(F.col(state).alias("state"), F.lead(state).over(w).alias("after")).where("after is not null").groupBy("state", "after").agg(F.count("*").alias("n"))
    return pairs.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("state")))


def successor(pairs: DataFrame) -> DataFrame:
    """The most frequent successor of each state, by name among equals."""
    w = Window.partitionBy("state").orderBy(F.desc("n"), "after")
    return pairs.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").select("state", "after", "share")


def fill(sequences: DataFrame, pairs: DataFrame, state: str, missing: str, key: list[str], order: list[str], least: float = 0.5, most: int = 4096) -> DataFrame:
    """(key.., order.., filled): a missing state becomes its predecessor's successor if that is likely enough.

    A filled state is the predecessor of the next, so the kth missing state behind a known one (or behind the first of
    all) is the successor map applied k times. The powers of the map, a table of states, are made up to the number of
    states, from where on they run in a cycle. More than `most` states are refused.
    """
    spark = sequences.sparkSession
    table = {r.state: r.after for r in successor(pairs).where(F.col("share") >= least).limit(most + 1).collect()}
    if len(table) > most:
        raise ValueError(f"more than {most} states with a likely successor")
    paths = []
    for s in {missing, *table, *table.values()}:
        path, at = [s], {s: 0}
        while True:
            nxt = table.get(path[-1], missing)
            if nxt in at:
                break
            at[nxt] = len(path)
            path.append(nxt)
        paths.append((s, path, at[nxt]))
    powers = spark.createDataFrame(paths, "anchor string, path array<string>, back int")
    w = Window.partitionBy(*key).orderBy(*order)
    first = F.row_number().over(w) == 1
    known = first | (F.col(state) != missing)
    runs = sequences.select(*key, *order, F.col(state).alias("s"), F.when(known, F.col(state)).alias("anchor"), F.when(known, F.row_number().over(w)).alias("at"), F.row_number().over(w).alias("i"))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    runs = runs.select(*key, *order, "s", F.last("anchor", True).over(upto).alias("anchor"), (F.col("i") - F.last("at", True).over(upto)).alias("k"))
    n = F.size("path")
    place = F.when(F.col("k") < n, F.col("k")).otherwise(F.col("back") + (F.col("k") - F.col("back")) % (n - F.col("back")))
    # a state without a successor is followed by the missing state, and the map goes on from there
    path, back = next((x[1], x[2]) for x in paths if x[0] == missing)
    j = F.col("k") - 1
    lost = F.when(F.col("k") == 0, F.col("anchor")).otherwise(F.get(F.array(*map(F.lit, path)), F.when(j < len(path), j).otherwise(back + (j - back) % (len(path) - back)).cast("int")))
    return runs.join(F.broadcast(powers), "anchor", "left").select(*key, *order, F.coalesce(F.get("path", place.cast("int")), lost).alias("filled"))


def markov_scores(decisions: DataFrame, sequence: str, k: float = 0.5, rows: DataFrame | None = None) -> DataFrame:
    """(doc_id, p): probability of approval from two chains of transitions, one of each class.

    The chains are learned from decisions (doc_id, approved, sequence), and applied to rows (doc_id, sequence), by
    default the same. A transition that was never seen counts as k of the vocabulary's size, in both classes.
    """
    steps_of = lambda df, *cols: df.select("doc_id", *cols, F.explode(F.expr(f"transform(sequence(1, size({sequence}) - 1), i -> struct({sequence}[i - 1] as a, {sequence}[i] as b))")).alias("x")).select("doc_id", *cols, "x.*")
    steps = steps_of(decisions, "approved")
    vocabulary = steps.select("a").unionByName(steps.select(F.col("b").alias("a"))).agg(F.greatest(F.lit(1), F.countDistinct("a")).alias("v"))
    count = lambda c: F.count_if(F.col("approved") == c)
    pairs = steps.groupBy("a", "b").agg(count(1).alias("n1"), count(0).alias("n0"))
    froms = steps.groupBy("a").agg(count(1).alias("t1"), count(0).alias("t0"))
    classes = decisions.agg(F.log((count(1) + 1) / (count(0) + 1)).alias("prior")).crossJoin(vocabulary)
    n1, n0, t1, t0 = (F.coalesce(c, F.lit(0)) for c in ("n1", "n0", "t1", "t0"))
    ratio = F.log((n1 + k) / (t1 + k * F.col("v"))) - F.log((n0 + k) / (t0 + k * F.col("v")))
    asked = steps if rows is None else steps_of(rows)
    weighed = asked.join(pairs, ["a", "b"], "left").join(froms, "a", "left").crossJoin(F.broadcast(classes)).select("doc_id", ratio.alias("w"), "prior")
    sums = weighed.groupBy("doc_id").agg((F.sum("w") + F.max("prior")).alias("d"))
    d = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("d")))
    return sums.select("doc_id", (1 / (1 + F.exp(-d))).alias("p"))


def frequency_scores(decisions: DataFrame, rows: DataFrame, key_share: float = 0.6, smooth: float = 2.0) -> DataFrame:
    """(doc_id, p) of rows (doc_id, key, tags): the smoothed share of approvals of the key among decisions, and 0.4 of the mean of the tags' that occur there."""
    rate = (F.sum("approved") + smooth * 0.5) / (F.count("*") + smooth)
    by_key = decisions.groupBy("key").agg(rate.alias("key_rate"))
    by_tag = decisions.select("approved", F.explode(F.array_distinct("tags")).alias("tag")).groupBy("tag").agg(rate.alias("rate"))
    tags = rows.select("doc_id", F.explode(F.array_distinct("tags")).alias("tag")).join(by_tag, "tag").groupBy("doc_id").agg(F.avg("rate").alias("tag_rate"))
    key_rate = F.coalesce("key_rate", F.lit(0.5))
    p = F.when(F.col("tag_rate").isNull(), key_rate).otherwise(key_share * key_rate + (1 - key_share) * F.col("tag_rate"))
    return rows.select("doc_id", "key").join(by_key, "key", "left").join(tags, "doc_id", "left").select("doc_id", p.alias("p"))


def prequential(decisions: DataFrame, key: str, order: str, smooth: float = 2.0, warm: int = 4) -> DataFrame:
    """(key, n, correct, log_loss): each decision is predicted from those of its key before it, then learned."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    n, a = F.count("*").over(w), F.coalesce(F.sum("approved").over(w), F.lit(0))
    df = decisions.select(key, "approved", n.alias("seen"), ((a + smooth * 0.5) / (n + smooth)).alias("p")).where(F.col("seen") >= warm)
    hit = F.when(F.col("approved") == 1, F.col("p")).otherwise(1 - F.col("p"))
    return df.groupBy(key).agg(F.count("*").alias("n"), F.count_if((F.col("p") >= 0.5) == (F.col("approved") == 1)).alias("correct"), F.avg(-F.log(hit)).alias("log_loss"))
