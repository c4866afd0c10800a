"""Degree, reachability and package metrics of directed graphs."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.plans.scratch import Rounds
from weftline.schema import COUPLING_TYPES


def degrees(nodes: DataFrame, edges: DataFrame, edge_types: Iterable[str] | None = COUPLING_TYPES) -> DataFrame:
    """id, ca (edges in), ce (edges out) of every node; parallel edges all count.

    One aggregation: each edge counts once for either end, summed map-side, so a hub is
    one row a task.
    """
    e = edges.filter(F.col("edge_type").isin(list(edge_types))) if edge_types else edges
    e = e.join(nodes.select(F.col("id").alias("source_id")), "source_id", "left_semi").join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    ends = e.select(F.explode(F.array(F.struct(F.col("target_id").alias("id"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("source_id").alias("id"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("x")).select("x.*")
    d = ends.groupBy("id").agg(F.sum("i").alias("ca"), F.sum("o").alias("ce"))
    return nodes.select("id").join(d, "id", "left").select("id", F.coalesce("ca", F.lit(0)).alias("ca"), F.coalesce("ce", F.lit(0)).alias("ce"))


def instability(ca: str = "ca", ce: str = "ce") -> Column:
    """ce / (ca + ce), 0.0 without edges."""
    return F.when(F.col(ca) + F.col(ce) == 0, 0.0).otherwise(F.col(ce) / (F.col(ca) + F.col(ce)))


def direct_coupling(nodes: DataFrame, edges: DataFrame, edge_types: Iterable[str] | None = COUPLING_TYPES) -> DataFrame:
    return degrees(nodes, edges, edge_types).withColumn("instability", instability())


def closure(edges: DataFrame, method: str = "frontier") -> DataFrame:
    """Distinct (source_id, target_id) with a path of one edge or more, without the pairs of a node with itself.

    `frontier` extends only the last round's new pairs by one edge: its joins make
    |closure| * out-degree rows, over as many rounds as the longest shortest path. Each
    round is a written table; a look for new pairs ends the loop. Cycles end, because known
    pairs are taken out. `doubling` doubles the length of the known paths in a round, on
    bits: `_doubled`. Who needs numbers instead of pairs takes `reach_counts`.
    """
    if method not in ("frontier", "doubling"):
        raise ValueError(f"unknown method {method!r}")
    rounds = Rounds(edges.sparkSession, "closure")
    step = rounds.keep(edges.select(F.col("source_id").alias("s"), F.col("target_id").alias("t")).filter("s is not null and t is not null and s != t").distinct(), "edges")
    if method == "doubling":
        return _doubled(step, rounds)
    known = new = step
    k = 0
    while True:
        k += 1
        longer = new.toDF("s", "m").join(step.toDF("m", "t"), "m")
        new = rounds.keep(longer.filter("s != t").select("s", "t").distinct().join(known, ["s", "t"], "left_anti"), f"new-{k}")
        if new.isEmpty():
            break
        known = known.union(new)
    return known.select(F.col("s").alias("source_id"), F.col("t").alias("target_id"))


WORDS = 8  # of 64 bits in a row
CHEAP = 1 << 24  # rows that a doubling join may always make
THIN = 16  # pairs a node at one distance, up to which paths double


def _doubled(step: DataFrame, rounds: Rounds) -> DataFrame:
    """The closure of distinct edges (s, t) by doubling paths.

    A row holds, for a node and a block of 64 * WORDS nodes that follow each other by id,
    which of these are nearer than d (`near`) and which are at exactly d (`far`). A path of
    more than d edges, up to 2d, has a node at d: so `far` pairs joined with the rows of
    their target give all that is nearer than 2d, or at 2d; pairs already near are never
    joined again. Where the pairs at d are too many for that (more than the edges, THIN a
    node, and CHEAP rows), a round goes on by one edge before `far` rows instead, until they are
    fewer. The number of pairs at d decides, and ends the loop; a round's table is deleted
    after the next.
    """
    ends = rounds.keep(step.select("s").union(step.select("t")).distinct().toDF("id"), "ends")
    nodes = ends.count()
    ids = ends.repartitionByRange(nodes // BITMAP + 1, "id").sortWithinPartitions("id")
    places = rounds.keep(ids.select("id", F.monotonically_increasing_id().alias("place")).withColumn("part", F.shiftright("place", 33)), "places")
    sizes = places.groupBy("part").agg(F.count("*").alias("n"))
    starts = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("start"))  # a row for BITMAP nodes
    ids = rounds.keep(places.join(starts, "part").select("id", (F.col("start") + F.col("place") % (1 << 33)).alias("no")), "ids")  # without gaps
    pairs = step.join(ids.toDF("s", "from"), "s").join(ids.toDF("t", "m"), "t").select(F.col("from").alias("s"), "m")
    pairs = rounds.keep(pairs, "pairs")
    links = pairs.count()
    near, far = ([f"{name}{i}" for i in range(WORDS)] for name in ("near", "far"))
    none = [F.lit(0).cast("long")] * WORDS
    own = [F.when(F.expr(f"m div 64 % {WORDS} = {i}"), F.expr("shiftleft(1L, cast(m % 64 as int))")).otherwise(none[i]) for i in range(WORDS)]
    bits = pairs.groupBy("s", F.expr(f"m div {64 * WORDS}").alias("block")).agg(*(F.bit_or(x).alias(c) for x, c in zip(own, far)))
    bits = rounds.keep(bits.select("s", "block", *(x.alias(c) for x, c in zip(none, near)), *far), "bits-0")
    k = 0
    while at_d := (size := bits.agg(F.count("*").alias("rows"), F.sum(sum(F.bit_count(c).cast("long") for c in far)).alias("far")).first()).far:
        k += 1
        if at_d <= max(links, THIN * nodes, CHEAP * nodes // size.rows):
            left, right = _set_bits(bits, far), bits.select(F.col("s").alias("m"), "block", *near, *far)
        else:
            some = bits.filter(" or ".join(f"{c} != 0" for c in far))
            left, right = pairs, some.select(F.col("s").alias("m"), "block", *(x.alias(c) for x, c in zip(none, near)), *far)
        via = left.join(right.hint("merge"), "m").select("s", "block", *near, *far)
        old = bits.select("s", "block", *(F.col(n).bitwiseOR(F.col(f)).alias(n) for n, f in zip(near, far)), *(x.alias(c) for x, c in zip(none, far)))
        all_ = via.union(old).groupBy("s", "block").agg(*(F.bit_or(c).alias(c) for c in near + far))
        bits = rounds.keep(all_.select("s", "block", *near, *(F.col(f).bitwiseAND(F.bitwise_not(n)).alias(f) for n, f in zip(near, far))), f"bits-{k}")
        rounds.forget(f"bits-{k - 1}")
    for name in ("edges", "ends", "places", "pairs"):
        rounds.forget(name)
    found = bits.agg(F.sum(sum(F.bit_count(c).cast("long") for c in near))).first()[0] or 0
    spread = bits.repartition(found // (1 << 18) + 1, "s", "block")  # a row becomes up to 64 * WORDS pairs
    named = spread.join(ids.toDF("source_id", "s"), "s")
    return _set_bits(named, near, "source_id").join(ids.toDF("target_id", "m"), "m").select("source_id", "target_id")


def _set_bits(bits: DataFrame, names: list[str], *more: str) -> DataFrame:
    """A row (s, m, more) for each bit, without those of a node for itself."""
    words = bits.select("s", *more, "block", F.posexplode(F.array(*names)).alias("word", "x")).filter("x != 0")
    each = words.select("s", *more, F.expr(f"(block * {WORDS} + word) * 64").alias("first"), "x", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("bit"))
    return each.filter("getbit(x, bit) = 1").select("s", *more, (F.col("first") + F.col("bit")).alias("m")).filter("s != m")


BITMAP = 1 << 15


def reach_counts(edges: DataFrame) -> DataFrame:
    """id, tca, tce of every node with an edge: how many reach it and how many it reaches; itself never counts.

    What a node reaches is a bitmap for each BITMAP nodes that follow each other by id. A
    round gives every node the union of its neighbours' bitmaps, an aggregation that starts
    before its shuffle, in both directions at once; V^2 pairs are V^2 bits. A round's
    number of bits ends the loop, and all rounds before the last are deleted.
    """
    rounds = Rounds(edges.sparkSession, "reach")
    e = rounds.keep(edges.select("source_id", "target_id").filter("source_id is not null and target_id is not null and source_id != target_id").distinct(), "pairs")
    ends = rounds.keep(e.select(F.col("source_id").alias("id")).union(e.select("target_id")).distinct(), "ends")
    ids = ends.repartitionByRange(ends.count() // BITMAP + 1, "id").sortWithinPartitions("id")
    ids = rounds.keep(ids.select("id", (F.monotonically_increasing_id() + 1).alias("no")), "ids")  # numbers from 1 on
    far = e.join(ids.toDF("source_id", "s"), "source_id").join(ids.toDF("target_id", "t"), "target_id").select("s", "t")
    step = rounds.keep(far.select(F.lit(0).alias("way"), "s", "t").union(far.select(F.lit(1), "t", "s")), "step")
    bits = step.groupBy("way", "s", F.bitmap_bucket_number("t").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("t")).alias("bits"))
    bits = rounds.keep(bits, "bits-0")
    k, total = 0, None
    while total != (now := bits.agg(F.sum(F.bitmap_count("bits"))).first()[0]):
        k, total = k + 1, now
        nexts = step.join(bits.select("way", F.col("s").alias("t"), "bucket", "bits"), ["way", "t"]).select("way", "s", "bucket", "bits")
        bits = rounds.keep(nexts.union(bits).groupBy("way", "s", "bucket").agg(F.bitmap_or_agg("bits").alias("bits")), f"bits-{k}")
        rounds.forget(f"bits-{k - 1}")
    at = F.bitmap_bit_position("s")
    own = F.conv(F.hex(F.substring("bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int").bitwiseAND(F.pow(F.lit(2), at % 8).cast("int")) != 0
    own = F.when(F.bitmap_bucket_number("s") == F.col("bucket"), own.cast("int")).otherwise(0)
    n = bits.groupBy("s").agg(*(F.coalesce(F.sum(F.when(F.col("way") == way, F.bitmap_count("bits") - own)), F.lit(0)).alias(name) for way, name in ((1, "tca"), (0, "tce"))))
    n = rounds.keep(ids.join(n, F.col("no") == F.col("s")).select("id", "tca", "tce"), "counts")
    for name in ("pairs", "ends", "ids", "step", f"bits-{k}"):
        rounds.forget(name)
    return n


def transitive_coupling(nodes: DataFrame, edges: DataFrame, edge_types: Iterable[str] | None = COUPLING_TYPES, method: str = "bitmaps") -> DataFrame:
    """id, tca, tce: nodes that reach each node, and that it reaches; itself never counts.

    Counted on bitmaps, or on the pairs of a closure's `method`. Edges from or to a node
    that is not among `nodes` are paths too, but such nodes are not counted.
    """
    e = edges.filter(F.col("edge_type").isin(list(edge_types))) if edge_types else edges
    if method != "bitmaps":
        reach = closure(e, method).withColumn("edge_type", F.lit("path"))
        return degrees(nodes, reach, None).select("id", F.col("ca").alias("tca"), F.col("ce").alias("tce"))
    ends = e.select(F.explode(F.array("source_id", "target_id")).alias("id")).filter("id is not null")
    if not ends.join(nodes.select("id"), "id", "left_anti").isEmpty():  # bits of unknown nodes can't be told from others
        return transitive_coupling(nodes, edges, edge_types, "frontier")
    n = reach_counts(e)
    return nodes.select("id").join(n, "id", "left").select("id", F.coalesce("tca", F.lit(0)).alias("tca"), F.coalesce("tce", F.lit(0)).alias("tce"))


def coupling(nodes: DataFrame, edges: DataFrame, edge_types: Iterable[str] | None = COUPLING_TYPES) -> DataFrame:
    return direct_coupling(nodes, edges, edge_types).join(transitive_coupling(nodes, edges, edge_types), "id").select("id", "ca", "ce", "tca", "tce", "instability")


def abstractness(classes: str = "classes", abstract: str = "abstract_classes", interfaces: str = "interfaces") -> Column:
    return F.when(F.col(classes) == 0, 0.0).otherwise((F.col(abstract) + F.col(interfaces)) / F.col(classes))


def main_sequence_distance(a: str = "abstractness", i: str = "instability") -> Column:
    return F.abs(F.col(a) + F.col(i) - 1.0)


def package_counts(classes: DataFrame, package: str = "package", kind: str = "kind", is_abstract: str = "is_abstract") -> DataFrame:
    """Classes, interfaces, abstract and concrete classes of each package; null or blank: (default)."""
    from weftline.schema import DEFAULT_PACKAGE

    name = F.coalesce(F.nullif(F.trim(package), F.lit("")), F.lit(DEFAULT_PACKAGE))
    interface, abstract = F.col(kind) == "interface", F.col(is_abstract) & (F.col(kind) != "interface")
    return classes.groupBy(name.alias("package")).agg(F.count("*").alias("classes"), F.count_if(interface).alias("interfaces"), F.count_if(abstract).alias("abstract_classes"), F.count_if(~interface & ~abstract).alias("concrete_classes"))


def package_coupling(classes: DataFrame, edges: DataFrame, edge_types: Iterable[str] | None = COUPLING_TYPES) -> DataFrame:
    """Coupling of the package graph with abstractness and distance; classes: id, package, kind, is_abstract."""
    from weftline.graph import Graph
    from weftline.schema import DEFAULT_PACKAGE

    name = F.coalesce(F.nullif(F.trim("package"), F.lit("")), F.lit(DEFAULT_PACKAGE))
    counts = package_counts(classes)
    e = edges.filter(F.col("edge_type").isin(list(edge_types))) if edge_types else edges
    pairs = Graph(classes, e).lifted(classes.select("id", name.alias("group"))).withColumn("edge_type", F.lit("depends"))
    packages = counts.select(F.col("package").alias("id"))
    c = coupling(packages, pairs, None).withColumnRenamed("id", "package")
    out = counts.join(c, "package").withColumn("abstractness", abstractness())
    return out.withColumn("distance", main_sequence_distance())


def ancestors(packages: DataFrame, package: str = "package") -> DataFrame:
    """Every dotted prefix of every package, itself included, once."""
    parts = F.split(package, r"\.")
    levels = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "."))
    return packages.filter(F.coalesce(F.col(package), F.lit("")) != "").select(F.explode(levels).alias("package")).distinct()


def inheritance(nodes: DataFrame, parents: DataFrame, deep: int = 3, most: int | None = None) -> DataFrame:
    """id, depth (hops to the topmost ancestor), root and is_deep (more than `deep` hops); parents: (id, parent), one row an id.

    Pointer doubling: each round joins everybody's ancestor at distance 2^k with that
    ancestor's own, so rounds grow with the logarithm of the depth, whatever it is. A chain
    without a cycle has fewer hops than there are nodes; nodes on or above a cycle reach
    that number, have no root and count as that deep. `most` gives another number.
    """
    rounds = Rounds(nodes.sparkSession, "inheritance")
    at = nodes.select("id").join(parents.select("id", "parent"), "id", "left")
    at = rounds.keep(at.select("id", F.coalesce("parent", "id").alias("up"), F.col("parent").isNotNull().cast("long").alias("hops")), "0")
    most = most or at.count() + 1  # a parent outside the nodes is one more
    k, reach, total = 0, 1, at.agg(F.sum("hops")).first()[0]
    while reach < most:
        k, reach = k + 1, reach * 2
        above = at.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("hops").alias("hops2"))
        new = at.join(above, "up", "left").select("id", F.coalesce("up2", "up").alias("up"), F.least(F.lit(most), F.col("hops") + F.coalesce("hops2", F.lit(0))).alias("hops"))
        at = rounds.keep(new, str(k))
        rounds.forget(str(k - 1))
        before, total = total, at.agg(F.sum("hops")).first()[0]
        if total == before:
            break
    root = F.when(F.col("hops") < most, F.col("up"))
    return at.select("id", F.col("hops").alias("depth"), root.alias("root"), (F.col("hops") > deep).alias("is_deep"))


def interface_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Direct, inherited and total interfaces: targets of `implements`, and those reached through `extends` and `implements`."""
    direct = edges.filter("edge_type = 'implements' and source_id != target_id").select("source_id", "target_id").distinct()
    reach = closure(edges.filter(F.col("edge_type").isin("extends", "implements")))
    interfaces = direct.select("target_id").distinct()
    total = reach.join(interfaces, "target_id", "left_semi").groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("total"))
    own = direct.groupBy(F.col("source_id").alias("id")).agg(F.count("*").alias("direct"))
    out = nodes.select("id").join(own, "id", "left").join(total, "id", "left")
    direct_, total_ = F.coalesce("direct", F.lit(0)), F.coalesce("total", F.lit(0))
    return out.select("id", direct_.alias("direct"), (total_ - direct_).alias("inherited"), total_.alias("total"))


def dependency_chains(edges: DataFrame, least: int = 2, most: int | None = None) -> DataFrame:
    """Simple paths of `least` edges or more (to `most`, if given) from nodes without incoming to nodes without outgoing edges, as ` -> ` strings.

    Paths are a frontier, one join a level, each level written, until none goes on. The
    number of paths is the result's own size.
    """
    rounds = Rounds(edges.sparkSession, "chains")
    e = edges.select("source_id", "target_id").filter("source_id != target_id").distinct()
    starts = e.select("source_id").distinct().join(e.select(F.col("target_id").alias("source_id")), "source_id", "left_anti")
    sinks = e.select("target_id").distinct().join(e.select(F.col("source_id").alias("target_id")), "target_id", "left_anti")
    step = e.select(F.col("source_id").alias("at"), F.col("target_id").alias("next"))
    paths = starts.select(F.col("source_id").alias("at"), F.array("source_id").alias("path"))
    out, n = None, 0
    while most is None or n < most:
        n += 1
        paths = paths.join(step, "at").filter(~F.array_contains("path", F.col("next"))).select(F.col("next").alias("at"), F.array_append("path", F.col("next")).alias("path"))
        paths = rounds.keep(paths, str(n))
        if n >= least:
            done = paths.join(sinks.withColumnRenamed("target_id", "at"), "at", "left_semi").select(F.array_join("path", " -> ").alias("chain"), F.lit(n).alias("length"))
            out = done if out is None else out.union(done)
        if n >= least and paths.isEmpty():
            break
    return out


def import_edges(files: DataFrame, name: str = "name", text: str = "text") -> DataFrame:
    """Edges `imports` from a file to the names it imports, each once; no wildcards, no java.lang except reflection."""
    from weftline.functions.text import imports

    e = files.select(F.col(name).alias("source_id"), F.explode(F.array_distinct(imports(F.col(text)))).alias("target_id"))
    t = F.col("target_id")
    return e.filter(~t.endswith("*") & (~t.startswith("java.lang.") | t.contains(".lang.reflect."))).withColumn("edge_type", F.lit("imports"))


def missing_targets(nodes: DataFrame, edges: DataFrame, node_type: str = "imported_class") -> DataFrame:
    """Stub nodes (id, node_type) for edge targets that no node has."""
    return edges.select(F.col("target_id").alias("id")).distinct().join(nodes.select("id"), "id", "left_anti").withColumn("node_type", F.lit(node_type))


def relation_edges(relations: DataFrame) -> DataFrame:
    """`uses` edges from (source_id, relation, target_id, position): no self edges; of a pair the first relation stays."""
    from weftline.operators.merge import first_wins

    r = first_wins(relations.filter("source_id != target_id"), ["source_id", "target_id"], "position", "relation")
    return r.select("source_id", "target_id", F.lit("uses").alias("edge_type"), F.col("relation").alias("relationship_kind"))
