"""N-gram Jaccard join: universe partition and pigeonhole, verified exactly.

A document's set is its distinct k-word shingles (A-Z lower-cased; a shorter text is
one shingle; no words: the empty set, linked with nothing). Documents link when
100 * intersection >= percent * union.

Candidates. Two linked sets of a and b elements differ in at most
H = (a + b) * (100 - percent) / (100 + percent) elements. The universe of hashed
shingles is cut into m segments, m by size band (sizes in [2^j, 2^(j+1)); sets close
enough to the next band's sizes also enter that band). A set's part in a segment is a
subset; of any H + 1 segments one must be equal in both sets. Each set therefore needs
just `need(n)` = H + 1 units, H for its largest possible partner, and takes the
cheapest ones by an order that depends on the subsets' content alone:

* subsets of two or more shingles, which few sets share, in segment order;
* then subsets of one shingle;
* if non-empty subsets run out, one-deletion neighbourhoods: a subset of two or more
  that is indexed with all its one-deletions covers a difference of one and counts
  twice. A set of which even that is too little enters a layer of twice as many segments.

Of two linked sets, the one that stops earlier in this order has taken H + 1 units, and
the other has indexed at least the same segments; so they meet. Empty subsets, which
would be the hottest index entries, are never indexed.

Verification. Equal sets (two 64-bit sums) are one node. In each index entry every node
is compared with the entry's leader, the node that has the most company in all its
entries, by their whole texts; links become components. What is left are pairs u, w with one leader r that are in
different components. With D(x) = x - r (symmetric differences, as all below),
u - w = D(u) - D(w), so a link needs |D(u) and D(w)| >= (|D(u)| + |D(w)| - H) / 2
(where that is 0 or less, both are linked to r). Then their prefixes of
(|D(u)| - |D(w)| + H) / 2 + 1 elements meet, in an order that has what a node adds to r
before what it lacks. Added shingles are rare, whatever text a group shares. Lacking
ones are common in a group of near copies, but they lie in both prefixes only if
|D(u)| <= H + |r| - |w| and the same for w, which hardly any node apart from r meets; they
are indexed by the sizes for which it holds. Differences of twice need(|r|) elements and
more (texts that share a passage with r and little else) are indexed by the universe
partition instead, whose subsets with two added shingles are rarer than single ones;
differences within H above that limit take part in both. Pairs that meet are checked
by parity sketches of SKETCH bits, then by their texts.

So a large group, of near copies or of texts with one passage, costs a number of rows
per member that does not grow with the group, and no link is missed.

Null ids are kept with a null component. Rows that share an id are one node. Further
columns are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.llm.components import components
from weftline.llm.shared import Scratch, bound_batches, lean
from weftline.llm.textkit import Words, mix, pieces, shingle_sets

LAYERS = 24
HOT, HOT_ROWS, SAMPLE, SALTS = 100_000, 32, 64, 1024
SKETCH = 1024
VERIFY_ROWS = 256


def need(n: np.ndarray, percent: int) -> np.ndarray:
    """One more than the elements in which a set of n can differ from a linked set of any size."""
    return (n + 100 * n // percent) * (100 - percent) // (100 + percent) + 1


def _order(n: np.ndarray, owner: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """Of each run, how many flagged runs of its owner stand before it."""
    before = np.cumsum(flag) - flag
    first = np.searchsorted(owner, np.arange(n))
    base = np.append(before, before[-1] + flag[-1] if len(before) else 0)[first]
    return before - base[owner]


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts) if len(starts) else np.zeros(0, np.uint64)


def index_entries(value: np.ndarray, doc: np.ndarray, size: np.ndarray, percent: int, rare: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(entry, set) for sets given as sorted values with their sets and all sets' sizes.

    `rare` says which values few sets have (all, if not given); subsets with two of them
    come first, then those with one, then the others.
    """
    out: list[tuple[np.ndarray, np.ndarray]] = []
    rare = np.ones(len(value), bool) if rare is None else rare
    band = np.maximum(1, size).astype(np.float64)
    band = (np.frexp(band)[1] - 1).astype(np.int64)
    for up in (0, 1):
        inside = size > 0 if not up else (size > 0) & (100 * size // percent >= 1 << (band + 1))
        b = band + up
        most = need((1 << (b + 1)) - 1, percent)
        segments = (4 * most + 2) // 3
        for layer in range(LAYERS):
            if not inside.any():
                break
            mine = inside[doc]
            entries, owners, inside = _layer(value[mine], doc[mine], rare[mine], size, inside, b, layer, segments << layer, percent)
            out += zip(entries, owners, strict=True)
    return np.concatenate([x for x, _ in out] or [np.zeros(0, np.uint64)]), np.concatenate([y for _, y in out] or [np.zeros(0, np.int64)])


def _layer(value, doc, rare, size, inside, band, layer, segments, percent):
    n = len(size)
    if layer == LAYERS - 1:  # every shingle its own segment
        seg = np.arange(len(value)).astype(np.uint64)
        tag = value
    else:
        seg = ((value >> np.uint64(32)) * segments[doc].astype(np.uint64)) >> np.uint64(32)
        tag = seg
    new = np.concatenate([[True], (seg[1:] != seg[:-1]) | (doc[1:] != doc[:-1])]) if len(seg) else np.zeros(0, bool)
    starts = np.flatnonzero(new)
    owner = doc[starts]
    length = np.diff(np.concatenate([starts, [len(value)]]))
    mixed = mix(value ^ np.uint64(0x5851F42D4C957F2D))
    total = _sums(mixed, starts)
    place = mix((tag[starts] << np.uint64(12)) ^ (band[owner].astype(np.uint64) << np.uint64(6)) ^ np.uint64(layer))
    goal = need(size, percent)
    few = np.add.reduceat(rare.astype(np.int64), starts) if len(starts) else length
    take, spent = np.zeros(len(starts), bool), np.zeros(n, np.int64)
    for kind in (few >= 2, few == 1, few == 0):
        take |= kind & (_order(n, owner, kind) < (goal - spent)[owner])
        spent += np.bincount(owner[kind], minlength=n)
    entries, owners = [mix(total[take] + place[take])], [owner[take]]
    # one-deletion neighbourhoods for what is still missing
    wide = length >= 2
    lack = goal - spent
    stuck = inside & (lack > np.bincount(owner[wide], minlength=n))
    if layer == LAYERS - 1:
        stuck = np.zeros(n, bool)
    near = (lack[owner] > 0) & ((_order(n, owner, wide) < lack[owner]) | stuck[owner])
    if near.any():
        salt = mix(place + np.uint64(1))
        entries.append(mix(total[near] + salt[near]))
        owners.append(owner[near])
        run = np.repeat(np.arange(len(starts)), length)
        less = (near & wide)[run]
        entries.append(mix((total[run] - mixed + salt[run])[less]))
        owners.append(owner[run][less])
    return entries, owners, stuck


SETS = "doc_id long, n_shingles long, set1 long, set2 long, sketch array<long>, entries array<long>"


def _sketches(value: np.ndarray, doc: np.ndarray, n: int) -> pa.Array:
    """Of each set, the parity of its elements in each of SKETCH cells."""
    cell = (mix(value ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(SKETCH - 1)).astype(np.int64)
    odd = np.bincount(doc * SKETCH + cell, minlength=n * SKETCH).astype(np.uint8) & 1
    words = np.packbits(odd, bitorder="little").view("<i8")
    return pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * (SKETCH // 64)), pa.array(words))


def _near(percent: int, n_u: str, n_v: str, s_u: str, s_v: str) -> Column:
    """Whether two sets can be linked, by their sizes and sketches."""
    differ = sum((F.bit_count(F.col(s_u)[i].bitwiseXOR(F.col(s_v)[i])) for i in range(1, SKETCH // 64)), F.bit_count(F.col(s_u)[0].bitwiseXOR(F.col(s_v)[0])))
    sizes = 100 * F.least(n_u, n_v) >= percent * F.greatest(n_u, n_v)
    return sizes & (differ * (100 + percent) <= (F.col(n_u) + F.col(n_v)) * (100 - percent))


def _sets(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, e, data, off in pieces(b.column("text")):
                value, doc, first = shingle_sets(Words(data, off, lower=True), k)
                size = np.diff(first)
                n = e - a
                entry, owner = index_entries(value, doc, size, percent)
                order = np.argsort(owner, kind="stable")
                cut = np.searchsorted(owner[order], np.arange(n + 1)).astype(np.int32)
                full = np.flatnonzero(size)
                one, two = np.zeros(n, np.uint64), np.zeros(n, np.uint64)
                one[full] = _sums(mix(value ^ np.uint64(0x14057B7EF767814F)), first[full])
                two[full] = _sums(mix(value ^ np.uint64(0x6C078965D5B2A5D3)), first[full])
                cols = [b.column("doc_id").slice(a, n), pa.array(size.astype(np.int64)), pa.array(one.view(np.int64)), pa.array(two.view(np.int64)), _sketches(value, doc, n), pa.ListArray.from_arrays(pa.array(cut), pa.array(entry[order].view(np.int64)))]
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_shingles", "set1", "set2", "sketch", "entries"])

    return run


def _text_sets(column: pa.Array, k: int) -> list[np.ndarray]:
    out = []
    for _, _, data, off in pieces(column):
        value, _, first = shingle_sets(Words(data, off, lower=True), k)
        out += np.split(value, first[1:-1])
    return out


def _verify(k: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, VERIFY_ROWS) for whole in batches for i in range(0, whole.num_rows, VERIFY_ROWS)):
            left, right = (pc.dictionary_encode(b.column(c)) for c in ("text_u", "text_v"))
            x, y = _text_sets(left.dictionary, k), _text_sets(right.dictionary, k)
            rows, wide = [], []
            for p, q in zip(left.indices.to_numpy(), right.indices.to_numpy(), strict=True):
                s, t = x[p], y[q]
                at = np.minimum(np.searchsorted(t, s), max(0, len(t) - 1))
                shared = t[at] == s if len(t) else np.zeros(len(s), bool)
                both = int(shared.sum())
                lacking = np.ones(len(t), bool)
                lacking[at[shared]] = False
                most, limit = int(need(np.array(len(s)), percent)) - 1, 2 * int(need(np.array(len(t)), percent))
                change = np.concatenate([s[~shared], t[lacking]])
                linked = both > 0 and 100 * both >= percent * (len(s) + len(t) - both)
                first = change[: most + 1] if len(change) < limit + most else change[:0]
                rows.append({"linked": linked, "n_u": len(s), "n_v": len(t), "added": len(s) - both, "differ": len(change), "change": first.view(np.int64)})
                order = np.argsort(change) if len(change) >= limit else np.zeros(0, np.int64)
                wide.append((change[order], order < len(s) - both))
            many = np.array([len(w) for w, _ in wide])
            sizes = np.where(many > 0, [r["n_u"] for r in rows], 0)
            value, added = (np.concatenate(z) for z in zip(*wide, strict=True))
            entry, owner = index_entries(value, np.repeat(np.arange(len(rows)), many), sizes, percent, added)
            order = np.argsort(owner, kind="stable")
            cut = np.searchsorted(owner[order], np.arange(len(rows) + 1)).astype(np.int32)
            out = pa.RecordBatch.from_pylist(rows, _FOUND)
            subsets = pa.ListArray.from_arrays(pa.array(cut), pa.array(entry[order].view(np.int64)))
            yield pa.RecordBatch.from_arrays([b.column("u"), b.column("v"), *out.columns, subsets], ["u", "v", *out.schema.names, "subsets"])

    return run


_FOUND = pa.schema([("linked", pa.bool_()), ("n_u", pa.int64()), ("n_v", pa.int64()), ("added", pa.int64()), ("differ", pa.int64()), ("change", pa.list_(pa.int64()))])
FOUND = "u long, v long, linked boolean, n_u long, n_v long, added long, differ long, change array<long>, subsets array<long>"


def _compared(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Of pairs (u, v), by their whole texts: whether they are linked, and how u differs from v."""
    j = pairs.join(texts.select(F.col("doc_id").alias("u"), F.col("text").alias("text_u")), "u")
    j = j.join(texts.select(F.col("doc_id").alias("v"), F.col("text").alias("text_v")), "v")
    return j.select("u", "v", "text_u", "text_v").mapInArrow(lean(_verify(k, percent)), FOUND)


PREFIXES = "v long, shingle long, own long, other long, place long, u long, c long, differ long, n long, apart boolean"
FLUSH_ROWS = 100_000


def _prefixes(percent: int):
    """Of each difference, the elements that can lie in a prefix, with their places from 0.

    Added elements have own = other = -1, subsets of a large difference -2. Lacking elements go to (own, other) size bands in
    which a partner of that size and this node can both have them in their prefixes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held = 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*out, strict=True)], ["v", "shingle", "own", "other", "place", "u", "c", "differ", "n", "apart"])

        for b in batches:
            cols = [b.column(x).to_pylist() for x in ("u", "c", "v", "cv", "n_u", "n_v", "added", "differ")]
            for i, (u, c, v, cv, n, r, added, d) in enumerate(zip(*cols, strict=True)):
                change = np.asarray(b.column("change")[i].values)
                subsets = np.asarray(b.column("subsets")[i].values)
                parts = [(0, min(added, len(change)), -1, -1)] * (len(change) > 0)
                if len(change) > added and (c != cv or n < r):
                    width = max(1, int(need(np.array(r), percent)) // 8)
                    for band in range(percent * n // 100 // width, 100 * n // percent // width + 1):
                        w = max(-(-percent * n // 100), band * width)
                        if d <= (n + w) * (100 - percent) // (100 + percent) + r - w:
                            parts.append((added, len(change), n // width, band))
                for a, e, own, other in parts:
                    k = e - a
                    out.append((np.full(k, v), change[a:e], np.full(k, own), np.full(k, other), np.arange(a, e), np.full(k, u), np.full(k, c), np.full(k, d), np.full(k, n), np.full(k, c != cv)))
                    held += k
                if k := len(subsets):
                    out.append((np.full(k, v), subsets, np.full(k, -2), np.full(k, -2), np.zeros(k, np.int64), np.full(k, u), np.full(k, c), np.full(k, d), np.full(k, n), np.full(k, c != cv)))
                    held += k
                if held >= FLUSH_ROWS:
                    yield flush()
                    out, held = [], 0
        if out:
            yield flush()

    return run


def _meeting(prefixes: DataFrame, percent: int) -> DataFrame:
    """Pairs (u, v) in different components, at least one apart from its leader, whose prefixes meet."""
    mine = prefixes.filter("apart").drop("apart").alias("x")
    y = prefixes.select("v", "shingle", F.col("own").alias("other"), F.col("other").alias("own"), F.col("place").alias("place2"), F.col("u").alias("w"), F.col("c").alias("c2"), F.col("differ").alias("differ2"), F.col("n").alias("n2"))
    most = F.floor((F.col("n") + F.col("n2")) * (100 - percent) / (100 + percent))
    more = F.col("differ") - F.col("differ2")
    fits = (2 * F.col("place") <= more + most) & (2 * F.col("place2") <= most - more) & (100 * F.least("n", "n2") >= percent * F.greatest("n", "n2"))
    met = mine.join(y, ["v", "shingle", "own", "other"]).filter((F.col("c") != F.col("c2")) & fits)
    return met.select(F.greatest("u", "w").alias("u"), F.least("u", "w").alias("v")).distinct()


def _shared(entries: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, entry, n) of the entries with more than one id, n of them.

    A window counts an entry's ids in one task, so the entries that a large part of all
    documents has are dealt over SALTS windows. They are those with at least 1 / HOT of a
    sample's rows, HOT at most, which is the bound of what is broadcast. Their n is what the
    sample says, which serves to choose leaders. An entry that the sample misses is counted
    by one window, only in a larger task.
    """
    sample = entries.filter(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0).groupBy("entry").agg(F.count("*").alias("n"))
    all_rows = sample.agg(F.sum("n")).first()[0] or 0
    hot = scratch.write(sample.filter(F.col("n") >= max(HOT_ROWS, all_rows // HOT)).select("entry", (F.col("n") * SAMPLE).alias("hot_n")), "hot")
    e = entries.join(F.broadcast(hot), "entry", "left")
    e = e.withColumn("salt", F.when(F.col("hot_n").isNotNull(), F.pmod(F.hash("doc_id"), F.lit(SALTS))).otherwise(0))
    e = e.withColumn("n", F.coalesce("hot_n", F.count("*").over(Window.partitionBy("entry", "salt"))))
    return e.filter("n > 1").select("doc_id", "entry", "n")


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest doc_id reachable by links, itself included) of each row."""
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    spark = docs.sparkSession
    bound_batches(spark)
    scratch = Scratch(spark, "ngram-join")
    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    full = scratch.write(src.mapInArrow(lean(_sets(k, percent)), SETS), "sets")
    sets = scratch.write(full.drop("entries"), "facts")
    ids = sets.filter("doc_id is not null and n_shingles > 0")

    # equal sets: each node is the smallest id of its class
    classes = ids.groupBy("set1", "set2").agg(F.min("doc_id").alias("node"), F.max("doc_id").alias("last")).filter("node < last")
    classes = scratch.write(classes, "classes")  # so that the join's shuffle can be split where a class is large
    copies = ids.select("doc_id", "set1", "set2").join(classes, ["set1", "set2"]).filter("doc_id != node").select("doc_id", "node")
    copies = scratch.write(copies.distinct(), "copies")

    entries = full.filter("doc_id is not null and n_shingles > 0").select("doc_id", F.explode("entries").alias("entry"))
    members = scratch.write(_shared(entries, scratch).join(copies.select("doc_id"), "doc_id", "left_anti").distinct(), "members")
    scratch.drop("sets", "hot")
    # an entry's leader is its node with the most company in all its entries: of edited copies, the least edited
    company = members.groupBy("doc_id").agg(F.sum("n").alias("company"))
    best = F.max_by("doc_id", F.struct("company", (-F.col("doc_id")).alias("first"))).alias("v")
    leaders = members.join(company, "doc_id").groupBy("entry").agg(best)
    first = members.join(leaders, "entry").filter("doc_id != v").select(F.col("doc_id").alias("u"), "v").distinct()
    tested = scratch.write(_compared(first, src, k, percent), "tested")
    part = components(tested.filter("linked").select("u", "v"), scratch, "near")

    # leaders of nodes in other components than their own
    of_node = part.select("node", "component")
    group = tested.join(of_node.withColumnRenamed("node", "u"), "u", "left").withColumn("c", F.coalesce("component", "u")).drop("component")
    group = group.join(of_node.withColumnRenamed("node", "v"), "v", "left").withColumn("cv", F.coalesce("component", "v")).drop("component")
    split = group.groupBy("v").agg(F.bool_or(F.col("c") != F.col("cv")).alias("apart"), F.count("*").alias("n")).filter("apart and n > 1").select("v")
    group = group.join(split, "v", "left_semi").select("u", "c", "v", "cv", "n_u", "n_v", "added", "differ", "change", "subsets")
    prefixes = scratch.write(group.mapInArrow(lean(_prefixes(percent)), PREFIXES), "prefixes")
    facts = ids.select("doc_id", "n_shingles", "sketch")
    of_u, of_v = (facts.toDF(x, f"n_{x}", f"s_{x}") for x in "uv")
    met = _meeting(prefixes, percent).join(of_u, "u").join(of_v, "v").filter(_near(percent, "n_u", "n_v", "s_u", "s_v")).select("u", "v").distinct()
    rest = met.join(tested.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), ["u", "v"], "left_anti")
    late = scratch.write(_compared(rest, src, k, percent).select("u", "v", "linked"), "late")
    links = part.select(F.col("node").alias("u"), F.col("component").alias("v")).union(late.filter("linked").select("u", "v")).union(copies.select(F.col("doc_id").alias("u"), F.col("node").alias("v")))
    final = components(links, scratch, "all")
    out = sets.select("doc_id", "n_shingles").join(final, F.col("doc_id") == F.col("node"), "left")
    out = scratch.write(out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")), "result")
    scratch.keep("result")
    return out
