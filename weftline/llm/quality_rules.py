"""Quality rules as a short-circuit cascade.

On a sample each rule's cost and selectivity are measured as they are at its place: the
seconds for what the rules before have not computed yet, and the share it rejects of
what they left. The rule with the most rejections per second comes next. A document that
one rule rejects is not seen by the next, so the costly rules (vocabulary, the most
frequent word pair, triple and four) run on few documents. The verdict is the conjunction of
all rules, so it does not depend on the order, on timing or on the sample.

`filter_quality` runs all rules so. `quality_report` has to tell the base features of
every document; the other rules run on those that the base rules leave.

The sample: the first SAMPLE_ROWS / SAMPLE_PARTS texts of at most SAMPLE_BYTES of each of
SAMPLE_PARTS partitions, evenly spaced over the table.

Words are `[^\\x20\\x09-\\x0D]+` runs of the whole text (null: no words). Features come
from arrays over bounded pieces of a batch (textkit); one pass, no shuffle.

Null texts and texts without words have n_words 0 and fail the length rule. Null ids,
repeated rows and ties: each row is judged alone. Further columns pass through
`filter_quality` unchanged and are dropped by `quality_report`.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.shared import bound_batches, lean
from weftline.llm.textkit import BYTE_BASE, WORD_BASES, Prefix, Words, byte_values, pieces, string_bytes

SYMBOLS = b"#*$%&|<>"
REPEAT_WINDOW = 8
SAMPLE_ROWS = 512
SAMPLE_PARTS = 16
SAMPLE_BYTES = 1 << 16


class Features:
    """Lazy features of a run of texts; those a cascade doesn't reach are not computed."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off
        self.memo: dict[str, np.ndarray] = {}

    def __getitem__(self, name: str) -> np.ndarray:
        if name not in self.memo:
            self.memo[name] = getattr(self, f"_{name}")()
        return self.memo[name]

    def __len__(self) -> int:
        return len(self.off) - 1

    def _per_text(self, at: np.ndarray) -> np.ndarray:
        return np.diff(np.searchsorted(at, self.off))

    def _words(self) -> Words:
        return Words(self.data, self.off)

    def _hashes(self) -> np.ndarray:
        return self["words"].hashes()

    def _n_words(self) -> np.ndarray:
        return self["words"].count

    def _word_chars(self) -> np.ndarray:
        d = self.data
        starts = np.flatnonzero(((d & 0xC0) != 0x80) & (d != 0x20) & ~((d >= 9) & (d <= 13)))
        return self._per_text(starts)

    def _n_symbols(self) -> np.ndarray:
        table = np.zeros(256, bool)
        table[list(SYMBOLS)] = True
        return self._per_text(np.flatnonzero(table[self.data]))

    def _n_digits(self) -> np.ndarray:
        return self._per_text(np.flatnonzero((self.data >= 48) & (self.data <= 57)))

    def _n_lines(self) -> np.ndarray:
        return self._per_text(np.flatnonzero(self.data == 10)) + 1

    def _n_dup_lines(self) -> np.ndarray:
        """Lines (split at \\n only) that hold a word and equal an earlier line of the text."""
        w: Words = self["words"]
        cuts = np.flatnonzero(self.data == 10)
        start = np.union1d(self.off[:-1][np.diff(self.off) > 0], cuts + 1)
        start = start[start < len(self.data)]
        end = np.concatenate([start[1:], [len(self.data)]]) if len(start) else start
        # the line's end without its \n; a text's last line ends with the text
        end = end - ((end > start) & (self.data[np.maximum(end - 1, 0)] == 10)) if len(start) else end
        filled = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
        start, end = start[filled], end[filled]
        doc = np.searchsorted(self.off, start, "right") - 1
        h = Prefix(byte_values()[self.data], BYTE_BASE).hash(start, end)
        order = np.lexsort((h, doc))
        h, doc = h[order], doc[order]
        again = np.flatnonzero((h[1:] == h[:-1]) & (doc[1:] == doc[:-1])) + 1
        return np.bincount(doc[again], minlength=len(self))

    def _n_repeat_words(self) -> np.ndarray:
        """Words inside windows of 8 words that the text holds twice or more, first ones included."""
        w: Words = self["words"]
        at, doc = w.runs(REPEAT_WINDOW)
        h = Prefix(self["hashes"], WORD_BASES[0]).hash(at, at + REPEAT_WINDOW)
        order = np.lexsort((h, doc))
        same = (h[order][1:] == h[order][:-1]) & (doc[order][1:] == doc[order][:-1])
        twice = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(order) else np.zeros(0, bool)
        edge = np.zeros(len(w) + 1, np.int64)
        hit = at[order[twice]]
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + REPEAT_WINDOW, -1)
        return np.bincount(w.doc[np.cumsum(edge[:-1]) > 0], minlength=len(self))

    def _n_worded(self) -> np.ndarray:
        """Words with a letter (any byte of a character beyond ASCII counts as one)."""
        w: Words = self["words"]
        d = self.data
        letter = np.concatenate([[0], np.cumsum((d >= 0x80) | ((d | 0x20) >= 97) & ((d | 0x20) <= 122))])
        return np.bincount(w.doc[letter[w.end] > letter[w.start]], minlength=len(self))

    def _n_distinct(self) -> np.ndarray:
        w: Words = self["words"]
        order = np.lexsort((self["hashes"], w.doc))
        h, doc = self["hashes"][order], w.doc[order]
        new = np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]) if len(h) else np.zeros(0, bool)
        return np.bincount(doc[new], minlength=len(self))

    def _top(self, k: int) -> np.ndarray:
        """How often the most frequent run of k words stands in each text."""
        w: Words = self["words"]
        at, doc = w.runs(k)
        out = np.zeros(len(self), np.int64)
        if len(at):
            h = Prefix(self["hashes"], WORD_BASES[0]).hash(at, at + k)
            order = np.lexsort((h, doc))
            h, doc = h[order], doc[order]
            new = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])]))
            np.maximum.at(out, doc[new], np.diff(np.concatenate([new, [len(h)]])))
        return out

    def _n_top2(self) -> np.ndarray:
        return self._top(2)

    def _n_top3(self) -> np.ndarray:
        return self._top(3)

    def _n_top4(self) -> np.ndarray:
        return self._top(4)

    def fork(self) -> Features:
        """The same texts with what is known so far; what is computed on it stays there."""
        out = Features(self.data, self.off)
        out.memo = dict(self.memo)
        return out

    def take(self, rows: np.ndarray) -> Features:
        """The features of some of the texts; what is known of them comes along."""
        if len(rows) == len(self):
            return self
        size = np.diff(self.off)[rows]
        off = np.concatenate([[0], np.cumsum(size)])
        at = np.repeat(self.off[:-1][rows] - off[:-1], size) + np.arange(off[-1])
        out = Features(self.data[at], off)
        out.memo = {k: v[rows] for k, v in self.memo.items() if k.startswith(("n_", "word_chars"))}
        return out


@dataclass(frozen=True)
class Rule:
    """`passes` takes the features of a run of texts and says which of them pass."""

    name: str
    passes: Callable[[Features], np.ndarray] = field(compare=False)


def _share(part: str, whole: str, most: int) -> Callable[[Features], np.ndarray]:
    """100 * part <= most * whole."""
    return lambda f: 100 * f[part] <= most * f[whole]


BASE_RULES = (
    Rule("enough_words", lambda f: f["n_words"] >= 20),
    Rule("few_repeats", _share("n_repeat_words", "n_words", 30)),
)
RULES = BASE_RULES + (
    Rule("few_symbols", _share("n_symbols", "n_words", 25)),
    Rule("few_dup_lines", lambda f: 2 * f["n_dup_lines"] <= f["n_lines"]),
    Rule("word_length", lambda f: (f["word_chars"] >= 2 * f["n_words"]) & (f["word_chars"] <= 15 * f["n_words"])),
    Rule("words_have_letters", lambda f: 100 * f["n_worded"] >= 70 * f["n_words"]),
    Rule("vocabulary", lambda f: (f["n_words"] < 200) | (100 * f["n_distinct"] >= 2 * f["n_words"])),
    Rule("no_common_pair", lambda f: (f["n_words"] < 50) | _share("n_top2", "n_words", 10)(f)),
    Rule("no_common_triple", lambda f: (f["n_words"] < 50) | _share("n_top3", "n_words", 6)(f)),
    Rule("no_common_four", lambda f: (f["n_words"] < 50) | _share("n_top4", "n_words", 4)(f)),
)


def judge(f: Features, rules: tuple[Rule, ...]) -> np.ndarray:
    """The cascade over a run of texts: each rule sees what the earlier ones left."""
    out, alive = np.zeros(len(f), bool), np.arange(len(f))
    for rule in rules:
        if not len(alive):
            break
        ok = rule.passes(f)
        alive, f = alive[ok], f.take(np.flatnonzero(ok))
    out[alive] = True
    return out


def order_rules(texts: list[str | None], rules: tuple[Rule, ...] = RULES, done: tuple[Rule, ...] = ()) -> list[dict]:
    """The rules in their order, with cost (seconds a text), share rejected and rank at their place; names break ties.

    `done` rules ran before. A rule that is cheap only because of those before it has no
    higher rank than they.
    """
    f = Features(*string_bytes(pa.array(texts, pa.string())))
    for rule in done:
        f = f.take(np.flatnonzero(rule.passes(f)))
    for rule in rules:  # once unmeasured: tables and caches
        rule.passes(f.fork())
    out, left, most = [], list(rules), float("inf")
    while left:
        tried = []
        for rule in left:
            fork, began = f.fork(), time.perf_counter()
            ok = rule.passes(fork)
            cost = (time.perf_counter() - began) / max(1, len(f)) + 1e-9
            rejected = float(1 - ok.mean()) if len(ok) else 0.0
            tried.append(((-rejected / cost, cost, rule.name), rule, rejected, fork, ok))
        (rank, cost, name), rule, rejected, f, ok = min(tried, key=lambda x: x[0])
        most = min(most, -rank)
        out.append({"rule": name, "cost": cost, "rejected": rejected, "rank": most})
        left.remove(rule)
        f = f.take(np.flatnonzero(ok))
    return out


def sample_texts(docs: DataFrame, text_col: str = "text", rows: int = SAMPLE_ROWS, parts: int = SAMPLE_PARTS) -> list[str | None]:
    """At most `rows` texts of at most SAMPLE_BYTES, from the heads of at most `parts` evenly spaced partitions."""
    text = F.col(text_col).cast("string")
    data = docs.select(text.alias("text")).filter(text.isNull() | (F.octet_length(text) <= SAMPLE_BYTES)).rdd
    n = data.getNumPartitions()
    parts = min(n, parts, rows)
    if not parts:
        return []
    each = rows // parts
    chosen = [i * n // parts for i in range(parts)]
    return [r.text for r in docs.sparkSession.sparkContext.runJob(data, lambda it: list(islice(it, each)), chosen)]


def plan_cascade(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, done: tuple[Rule, ...] = ()) -> tuple[Rule, ...]:
    """The rules in the order of `order_rules` on a bounded sample, which sets nothing but that order."""
    names = {r.name: r for r in rules}
    return tuple(names[x["rule"]] for x in order_rules(sample_texts(docs, text_col, sample_rows), rules, done))


REPORT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


def quality_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Base features and base verdict of each document; `kept` is the cascade's verdict on those the base rules leave."""
    bound_batches(docs.sparkSession)
    cascade = plan_cascade(docs, text_col, tuple(r for r in rules if r not in BASE_RULES), sample_rows, BASE_RULES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, e, data, off in pieces(b.column("text")):
                f = Features(data, off)
                cols = {"doc_id": b.column("doc_id").slice(a, e - a)}
                cols |= {k: pa.array(f[k].astype(np.int64)) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
                passed = np.all([r.passes(f) for r in BASE_RULES], axis=0)
                kept = passed.copy()
                left = np.flatnonzero(passed)
                kept[left] = judge(f.take(left), cascade)
                yield pa.RecordBatch.from_pydict(cols | {"base_failed": pa.array(~passed), "kept": pa.array(kept)})

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, REPORT)


def filter_quality(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """The documents that pass every rule, all columns unchanged, by the short-circuit cascade."""
    bound_batches(docs.sparkSession)
    cascade = plan_cascade(docs, text_col, rules, sample_rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for a, e, data, off in pieces(b.column(text_col)):
                yield b.slice(a, e - a).filter(pa.array(judge(Features(data, off), cascade)))

    return docs.mapInArrow(lean(run), docs.schema)


ORACLE = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), runs AS (
  SELECT r, k, i, array_to_string(list_slice(w, i, i + k - 1), ' ') AS g
  FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d CROSS JOIN (VALUES (2), (3), (4), (8)) AS s(k) WHERE len(w) >= k)
), uses AS (
  SELECT r, k, g, count(*) AS n, list(i) AS places FROM runs GROUP BY r, k, g
), top AS (
  SELECT r, max(n) FILTER (k = 2) AS top2, max(n) FILTER (k = 3) AS top3, max(n) FILTER (k = 4) AS top4 FROM uses GROUP BY r
), repeated AS (
  SELECT r, count(DISTINCT i + x) AS n_repeat_words
  FROM (SELECT r, unnest(places) AS i FROM uses WHERE k = 8 AND n > 1), range(8) AS o(x) GROUP BY r
), f AS (
  SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0) AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]'))) - len(list_distinct(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')))) AS n_dup_lines,
         len(string_split(text, chr(10))) AS n_lines,
         coalesce(n_repeat_words, 0) AS n_repeat_words,
         len(list_filter(w, lambda x: regexp_matches(x, '[A-Za-z]|[^\\x00-\\x7F]'))) AS n_worded, len(list_distinct(w)) AS n_distinct,
         coalesce(top2, 0) AS top2, coalesce(top3, 0) AS top3, coalesce(top4, 0) AS top4
  FROM d LEFT JOIN top USING (r) LEFT JOIN repeated USING (r)
), b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
       n_repeat_words::BIGINT AS n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_symbols <= 25 * n_words AND 2 * n_dup_lines <= n_lines AND word_chars BETWEEN 2 * n_words AND 15 * n_words
       AND 100 * n_worded >= 70 * n_words AND (n_words < 200 OR 100 * n_distinct >= 2 * n_words)
       AND (n_words < 50 OR 100 * top2 <= 10 * n_words AND 100 * top3 <= 6 * n_words AND 100 * top4 <= 4 * n_words) AS kept
FROM b
"""
