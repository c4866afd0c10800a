"""Tags: statistics, producers and consumers, and similar names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tag_rows(nodes: DataFrame) -> DataFrame:
    return nodes.select("id", F.explode(F.array_distinct("tags")).alias("tag"))


def tag_statistics(nodes: DataFrame) -> DataFrame:
    return tag_rows(nodes).groupBy("tag").agg(F.count("*").alias("nodes")).orderBy(F.desc("nodes"), "tag")


def tags_to_array(nodes: DataFrame, rows: DataFrame) -> DataFrame:
    """id and its sorted tags as a JSON array; nodes without rows get []."""
    t = rows.groupBy("id").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    return nodes.select("id").join(t, "id", "left").select("id", F.to_json(F.coalesce("tags", F.expr("array()").cast("array<string>"))).alias("tags"))


def producers_consumers(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    """producer, consumer and the sorted tags between them, joined by comma; both frames: (rule, tag); no self pairs."""
    p, c = producers.select(F.col("rule").alias("producer"), "tag").distinct(), consumers.select(F.col("rule").alias("consumer"), "tag").distinct()
    j = p.join(c, "tag").filter("producer != consumer")
    return j.groupBy("producer", "consumer").agg(F.array_join(F.array_sort(F.collect_set("tag")), ",").alias("tags"))


def unused_tags(producers: DataFrame, consumers: DataFrame) -> DataFrame:
    return producers.select("tag").distinct().join(consumers.select("tag"), "tag", "left_anti")


def multi_producers(producers: DataFrame) -> DataFrame:
    g = producers.groupBy("tag").agg(F.array_sort(F.collect_set("rule")).alias("rules"))
    return g.filter(F.size("rules") > 1).select("tag", F.size("rules").cast("long").alias("producers"), F.array_join("rules", ",").alias("rules"))


# What names are compared without, taken out in this order.
NOISE = ("[._-]", "detected?", "found", "usage", "used", "pattern", "template", "config", "configuration", "impl", "implementation", "mgmt", "management", "svc", "service", "s$", r"\d+")
# Words for the same thing.
PAIRED = (
    ("DETECTED", "FOUND"),
    ("DETECTOR", "FINDER"),
    ("USAGE", "USED"),
    ("PATTERN", "TEMPLATE"),
    ("CONFIG", "CONFIGURATION"),
    ("IMPL", "IMPLEMENTATION"),
    ("MGMT", "MANAGEMENT"),
    ("SVC", "SERVICE"),
)
# Contexts and the words that tell them.
CONTEXTS = {
    "ejb_context": ("EJB", "ENTERPRISE_BEAN", "SESSION_BEAN", "ENTITY_BEAN", "MESSAGE_DRIVEN"),
    "web_context": ("SERVLET", "JSP", "WEB", "HTTP", "WEBAPP"),
    "data_context": ("DATABASE", "DB", "SQL", "JDBC", "JPA", "HIBERNATE"),
    "config_context": ("CONFIG", "CONFIGURATION", "PROPERTIES", "SETTINGS", "PARAMS"),
    "transaction_context": ("TRANSACTION", "TX", "TRANSACTIONAL", "COMMIT", "ROLLBACK"),
}


def normal_name(name: Column) -> Column:
    """Lower case, without separators, noise words, plural and numbers."""
    out = F.lower(name)
    for part in NOISE:
        out = F.regexp_replace(out, part, "")
    return F.trim(out)


def edit_limit(a: Column, b: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.least(F.length(a), F.length(b)) / 3))


def similar_pairs(names: DataFrame, name: str = "name", *within: str) -> DataFrame:
    """Pairs a < b of distinct names whose normal forms are within max(1, floor(shorter length / 3)) edits.

    Normal forms of lengths m and n differ by |m - n| edits at least, so each form is
    looked up in the lengths it can reach: an equi join on the length (and on `within`),
    filtered by the edit distance. Equal forms meet too.
    """
    d = names.select(*within, F.col(name).alias("name")).filter(F.col("name").isNotNull()).distinct()
    forms = d.withColumn("form", normal_name(F.col("name"))).withColumn("n", F.length("form"))
    # the shorter one, m long, reaches lengths m to m + max(1, m / 3)
    reach = forms.withColumn("reach", F.explode(F.sequence(F.col("n"), F.col("n") + F.greatest(F.lit(1), F.floor(F.col("n") / 3)).cast("int"))))
    a = reach.select(*within, F.col("name").alias("x"), F.col("form").alias("fx"), F.col("reach").alias("n"))
    b = forms.select(*within, F.col("name").alias("y"), F.col("form").alias("fy"), "n")
    j = a.join(b, [*within, "n"]).filter((F.length("fx") < F.length("fy")) | ((F.length("fx") == F.length("fy")) & (F.col("x") < F.col("y"))))
    j = j.withColumn("distance", F.levenshtein("fx", "fy")).filter(F.col("distance") <= edit_limit(F.col("fx"), F.col("fy")))
    return j.select(*within, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")


def pattern_pairs(names: DataFrame, name: str = "name", any_case: bool = True) -> DataFrame:
    """Pairs a < b of names of which one holds a word of PAIRED and the other its partner, the rest being the same in normal form.

    An equi join on the pair of words and the rest. Words are found in any case, or only
    in upper case.
    """
    d = names.select(F.col(name).alias("name")).distinct()
    text = F.upper("name") if any_case else F.col("name")
    held = [F.struct(F.lit(i).alias("i"), text.contains(x).alias("x"), text.contains(y).alias("y"), normal_name(F.replace(F.replace(text, F.lit(x), F.lit("")), F.lit(y), F.lit(""))).alias("rest")) for i, (x, y) in enumerate(PAIRED)]
    d = d.select("name", F.explode(F.array(*held)).alias("h")).select("name", "h.*").filter("x or y")
    a, b = d.toDF("a", "i", "ax", "ay", "rest"), d.toDF("b", "i", "bx", "by", "rest")
    return a.join(b, ["i", "rest"]).filter("a < b and (ax and by or ay and bx)").select("a", "b").distinct()


def context_pairs(names: DataFrame, name: str = "name") -> DataFrame:
    """(context, a, b, distance): similar names of one context, compared without its words (longer words first)."""
    d = names.select(F.col(name).alias("name")).distinct()
    found = []
    for context, words in CONTEXTS.items():
        here, rest = F.lit(False), F.col("name")
        for w in sorted(words, key=lambda w: (-len(w), w)):
            here, rest = here | F.upper("name").contains(w), F.replace(rest, F.lit(w), F.lit(""))
        found.append(F.when(here, F.struct(F.lit(context).alias("context"), rest.alias("rest"))))
    d = d.select("name", F.explode(F.array_compact(F.array(*found))).alias("f")).select("f.context", "name", "f.rest")
    # names with one rest are compared once
    pairs = similar_pairs(d, "rest", "context")
    x, y = d.toDF("context", "x", "a"), d.toDF("context", "y", "b")
    j = pairs.join(x, ["context", "a"]).join(y, ["context", "b"]).select("context", F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "distance")
    same = d.toDF("context", "a", "rest").join(d.toDF("context", "b", "rest"), ["context", "rest"]).filter("a < b").select("context", "a", "b", F.lit(0).alias("distance"))
    return j.union(same).distinct()


def normal_groups(names: DataFrame, name: str = "name") -> DataFrame:
    """Normal forms that two or more names share, with the names."""
    d = names.select(F.col(name).alias("name")).distinct().groupBy(normal_name(F.col("name")).alias("form")).agg(F.array_sort(F.collect_set("name")).alias("names"))
    return d.filter(F.size("names") > 1).select("form", F.array_join("names", ",").alias("names"))


def hits_union(nodes: DataFrame, wanted: list[str]) -> DataFrame:
    """Each node with any of the tags, once, with the first wanted tag it has."""
    places = F.array(*map(F.lit, wanted))
    first = F.array_min(F.filter(F.transform("tags", lambda t: F.array_position(places, t)), lambda p: p > 0))
    return nodes.withColumn("place", first).filter("place is not null").select("id", F.element_at(places, F.col("place").cast("int")).alias("tag"))


def inverted_index(nodes: DataFrame) -> DataFrame:
    """Per tag the sorted ids of its nodes; one row a tag is the format, so a tag's ids are gathered."""
    return tag_rows(nodes).groupBy("tag").agg(F.count("*").alias("nodes"), F.array_join(F.array_sort(F.collect_list("id")), ",").alias("ids"))


def top(df: DataFrame, key: str, n: int) -> DataFrame:
    """The n most frequent keys; the key breaks ties."""
    return df.groupBy(key).agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), key).limit(n)


def newest(df: DataFrame, keys: list[str], order: str, n: int, *ties: str) -> DataFrame:
    """The n newest rows of each key, with their rank."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order), *ties)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
