import zlib

import numpy as np

import corpus_pipeline
from tests.llm import brute
from tests.llm.test_decontaminate import fold, plain
from tests.llm.test_token_output import plain as plain_tokens
from weftline.llm.mixing import mix_sources


def test_pipeline_equals_brute_force(spark, sf_dir):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = [r for r in source.collect() if brute.quality_kept(r.text)]
    groups = brute.components([(r.doc_id, r.text) for r in rows])
    rows = [r for r in rows if groups[r.doc_id][1] == r.doc_id]
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    grams = lambda t: set(zip(*(fold(t)[j:] for j in range(5)), strict=False))
    item_grams = {i: grams(x) for i, x in items}
    clean = []
    for r in rows:
        g = grams(r.text)
        clean += [r] * (not plain([(r.doc_id, r.text)], [(i, x) for i, x in items if item_grams[i] & g]))
    assert len(clean) < len(rows) < source.count()
    # the mix itself is held against SQL and resharing elsewhere; here its plan, from the brute-force rows
    mixed = []
    for r in mix_sources(spark.createDataFrame(clean, source.schema)).collect():
        left = r.mix_taken
        while left > 0:
            n = min(left, r.mix_size)
            mixed.append((r.doc_id, r.text if n == r.mix_size else " ".join(brute.words(r.text)[:n])))
            left -= n
    want, start = [], 0
    for i, ids in plain_tokens(sorted(mixed)):
        want.append((i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    got = corpus_pipeline.run(spark, sf_dir).orderBy("start").collect()
    assert sorted((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == sorted(want)
    for r in got:
        assert r.start == start
        start += r.n_tokens


def test_stages_keep_the_columns(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf_dir).dtypes == docs.dtypes
        assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_near_duplicates_keep_one_of_a_group(spark, sf_dir):
    """Rows that share an id but not a text are documents of their own; repeated rows are copies."""
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(3, text, "en", "s", 1), (1, text + " end", "en", "s", 1), (None, text, "en", "s", 1), (None, text, "en", "s", 1), (5, "", "en", "s", 0), (6, None, "en", "s", 0), (1, "other words", "en", "s", 2), (1, "other words", "en", "s", 2)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, schema), sf_dir).collect()
    assert sum(r.text == "other words" for r in kept) == 1
    assert sum((r.text or "").startswith("w0") for r in kept if r.doc_id) == 1
    assert len(kept) == 6 and sorted(r.doc_id for r in kept if not r.text) == [5, 6] and sum(r.doc_id is None for r in kept) == 2
    unique = [r for r in rows if r[1] != "other words"]
    kept = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(unique, schema), sf_dir).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 0, 1, 5, 6]


def test_stages_on_nulls_and_repeats(spark, sf_dir):
    item = spark.read.parquet(f"{sf_dir}/benchmark.parquet").first().text
    rows = [(None, None, None, None, None), (1, item, None, None, None), (1, item, None, None, None), (None, f"a {item}", "en", "s", 3), (2, "", None, "s", 0), (2, "own words here", None, "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clean = corpus_pipeline.decontaminate(spark, docs, sf_dir).collect()
    assert sorted((r.doc_id or 0, r.text or "") for r in clean) == [(0, ""), (2, ""), (2, "own words here")]
    mixed = corpus_pipeline.mix(spark, docs, sf_dir).collect()
    assert all(r.text for r in mixed) and {r.source for r in mixed} == {None, "s"}
    assert all(r.n_chars == len(r.text) for r in mixed)
