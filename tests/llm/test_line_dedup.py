from weftline.llm.line_dedup import line_dedup


def plain(rows, sites):
    where = {}
    for _, t, s in rows:
        for line in (t or "").split("\n"):
            where.setdefault(line.strip(" \t\r\x0b\x0c"), set()).update({s} - {None})
    out = []
    for i, t, _ in rows:
        lines = [] if t is None else t.split("\n")
        kept = [x for x in lines if not x.strip(" \t\r\x0b\x0c") or len(where[x.strip(" \t\r\x0b\x0c")]) < sites]
        out.append((i, len(lines), len(lines) - len(kept), None if t is None else "\n".join(kept)))
    return sorted(out, key=repr)


def got(spark, rows, sites, schema="doc_id long, text string, source string"):
    return sorted(map(tuple, line_dedup(spark.createDataFrame(rows, schema), sites).collect()), key=repr)


def test_table(spark, sf_dir):
    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    rows = [tuple(r) for r in d.collect()]
    for sites in (2, 5, 12):
        assert sorted(map(tuple, line_dedup(d, sites).collect()), key=repr) == plain(rows, sites)


def test_edges(spark):
    rows = [(1, None, "a"), (2, "", "a"), (3, "\n\n", "b"), (4, "menu\nown", "a"), (5, " menu\r\nmine", "b"), (5, " menu\r\nmine", "b"), (None, "menu", "c"), (6, "menu", None), (7, "x\nmenu\nx", "c"), (8, "mine", "a")]
    for sites in (1, 2, 3, 4):
        assert got(spark, rows, sites) == plain(rows, sites)
    wide = [(*r, "k", 1) for r in rows]
    assert got(spark, wide, 3, "doc_id long, text string, source string, line string, a int") == plain(rows, 3)
    assert got(spark, [], 2) == []


def test_many_sites_around_the_threshold(spark):
    """Thresholds far above what a sketch counts exactly."""
    rows = [(i, "\n".join(f"line {k}" for k in range(40) if i < 960 + 2 * k), f"site{i}") for i in range(1100)]
    assert got(spark, rows, 1000) == plain(rows, 1000)
