import random
import re

from weftline.llm.license_scan import TEMPLATES, TEXTS, all_templates, license_scan, marks


def folded(t):
    return re.sub("[^a-z0-9]+", " ", t.lower()).split()


def plain(rows, percent):
    out = {}
    known = [(i, n, {*zip(folded(t)[:-1], folded(t)[1:], strict=True)}) for i, (n, t) in enumerate(all_templates())]
    for doc, text in rows:
        if text is None:
            continue
        paragraphs = re.split(r"\n[ \t\r]*\n\s*", text)
        units = [("line", i, x) for i, x in enumerate(text.split("\n"))] + [("paragraph", i, x) for i, x in enumerate(paragraphs) if "\n" in x]
        units += [("text", 0, text)] * (len(paragraphs) > 1)
        for kind, no, x in units:
            w = folded(x)
            g = {*zip(w[:-1], w[1:], strict=True)}
            for i, name, t in known:
                shared = len(g & t)
                if g and 200 * shared >= percent * (len(g) + len(t)):
                    key = (-2.0 * shared / (len(g) + len(t)), i, kind, no, shared, len(g))
                    out[doc, name] = min(out.get((doc, name), key), key)
    return {k: (v[2], v[3], v[4], v[5], -v[0]) for k, v in out.items()}


def got(df, percent=80):
    return {(r.doc_id, r.license): (r.kind, r.no, r.shared, r.unit_bigrams, r.dice) for r in license_scan(df, percent).collect()}


def test_table(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in d.collect()]
    for percent in (80, 50):
        want = plain(rows, percent)
        assert got(d, percent) == want and want


def test_edges(spark):
    mit, bsd = TEMPLATES[2][1], TEMPLATES[-2][1]
    rows = [(1, None), (2, ""), (3, "license"), (4, mit), (5, mit.replace(", ", ",\n").upper()), (6, "a\n\nb\n \n" + bsd), (7, mit[: len(mit) // 2]), (None, TEMPLATES[0][1]), (8, "\n".join([TEMPLATES[0][1]] * 3)), (9, " ".join([TEMPLATES[0][1]] * 500)), (10, "x " * 50_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(df) == plain(rows, 80)
    assert (5, "MIT") in got(df) and (7, "MIT") not in got(df)
    extra = spark.createDataFrame([(*r, "l", 0) for r in rows], "doc_id long, text string, license string, no int")
    assert got(extra) == plain(rows, 80)
    assert got(df.limit(0)) == {}


def test_whole_texts_and_their_parts(spark):
    rows = []
    for i, (_, parts) in enumerate(TEXTS):
        text = "Copyright (c) 2020 Some Holder\n\n" + "\n\n".join(parts)
        wrapped = re.sub(r"((?:\S+ ){9}\S+) ", r"\1\n * ", text)
        rows += [(3 * i, text), (3 * i + 1, wrapped.upper()), (3 * i + 2, "own words " * 400 + "\n\n" + parts[1] + "\n\n" + "and more " * 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = got(df)
    assert found == plain(rows, 80)
    for i, (name, parts) in enumerate(TEXTS):
        assert found[3 * i, name][0] in ("text", "line") and (3 * i + 1, name) in found
        assert any(d == 3 * i + 2 for d, _ in found) or len(parts[1].split()) < 8


def test_no_match_is_without_a_mark():
    """Every choice of the bigrams that a match needs holds a mark, also the choice with the fewest."""
    rng = random.Random(4)
    for percent in (50, 80, 95):
        words = set(marks(all_templates(), percent))
        for _, text in all_templates():
            w = folded(text)
            pairs = sorted({*zip(w[:-1], w[1:], strict=True)})
            least = -(-percent * len(pairs) // (200 - percent))
            plainest = sorted(pairs, key=lambda p: bool(words & set(p)))[:least]
            assert any(words & set(p) for p in plainest)
            assert any(words & set(p) for p in rng.sample(pairs, least))


def test_long_text(spark):
    rows = [(1, "line of words without a licence\n" * 100_000 + TEMPLATES[0][1]), (2, "software " * 300_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {k: v[:2] for k, v in got(df).items()} == {(1, "MIT"): ("line", 100_000)}
