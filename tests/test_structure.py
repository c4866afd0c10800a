"""Class rules on hand-made classes; templates; numbers of reached nodes in several bitmaps."""

from pyspark.sql import functions as F

from weftline.operators import coupling as cp
from weftline.operators import tags as tg
from weftline.plans import structure as st

CLASSES = "id string, name string, kind string, is_interface boolean, annotations array<string>, supertypes array<string>, imports array<string>, private_constructor boolean"
FIELDS = "id string, name string, type string, is_static boolean, is_final boolean, annotations array<string>"
METHODS = "id string, name string, return_type string, is_static boolean, is_public boolean, is_synchronized boolean, annotations array<string>"


def test_anti_patterns(spark):
    classes = spark.createDataFrame([("a", "A", "STATELESS", False, [], [], ["javax.naming.Context", "a.Executor"], False), ("b", "B", None, False, None, None, None, False)], CLASSES)
    fields = spark.createDataFrame(
        [
            ("a", "n", "int", False, False, []),
            ("a", "log", "Logger", False, False, []),
            ("a", "k", "int", True, False, []),
            ("a", "ev", "Event", False, False, ["Inject"]),
            ("a", "m", "ConcurrentHashMap", False, False, ["Inject"]),
            ("b", "m", "HashMap", False, False, []),
            ("b", "myCACHE", "int", False, True, []),
            ("b", "ds", "DataSource", False, True, ["Autowired"]),
            ("b", "ds2", "DataSource", False, True, None),
            ("b", None, None, False, False, None),
        ],
        FIELDS,
    )
    methods = spark.createDataFrame([("b", "GetThing", "T", True, True, False, []), ("b", "getThing", "void", True, True, False, []), ("b", "closeStatement", "void", False, True, False, []), ("b", "doLookup", "T", False, True, False, None)], METHODS)
    got = {(r.id, r.type, r.location) for r in st.anti_patterns(classes, fields, methods).collect()}
    assert got == {
        ("a", "MUTABLE_STATE_IN_STATELESS_BEAN", "field:n"),
        ("a", "MUTABLE_STATE_IN_STATELESS_BEAN", "field:m"),
        ("b", "NON_THREAD_SAFE_COLLECTION", "field:m"),
        ("b", "CACHING_IN_STATELESS_BEAN", "field:myCACHE"),
        ("b", "UNINJECTED_RESOURCE", "field:ds2"),
        ("b", "FACTORY_METHOD", "method:GetThing"),
        ("b", "MANUAL_RESOURCE_MANAGEMENT", "method:closeStatement"),
        ("b", "JNDI_LOOKUP", "method:doLookup"),
        ("a", "JNDI_LOOKUP", "class"),
        ("a", "THREAD_MANAGEMENT", "class"),
    }


def test_levels_at_their_bounds(spark):
    classes = spark.createDataFrame([(k, "A", "ENTITY", False, [], [], [], False) for k in "xyz"], CLASSES)
    methods = spark.createDataFrame([("y", "ejbCreate", "void", False, True, False, ["PostConstruct"])] * 2 + [("x", "run", "void", False, True, False, ["RunAs"])], METHODS)
    got = {r.id: (r.score, r.level) for r in st.migration_complexity(classes, spark.createDataFrame([], FIELDS), methods).collect()}
    assert got == {"x": (5, "MEDIUM"), "y": (8, "HIGH"), "z": (4, "MEDIUM")}
    rows = [("a", 1, 11, 1, 1, 4, 1, 11, 1), ("b", 1, 6, 0, 0, 0, 0, 0, 1), ("c", 0, 6, 0, 0, 0, 0, 20, 1), ("d", 1, 5, 1, 0, 1, 0, 0, 0)]
    features = spark.createDataFrame(rows, "id string, is_dto int, fields int, value_object int, immutable int, mapping_methods int, row_mappings int, row_calls int, jdbc int")
    assert {r.id: (r.score, r.level) for r in st.data_transfer(features).collect()} == {"a": (13, "HIGH"), "b": (3, "LOW"), "d": (4, "MEDIUM")}


def test_templates(spark):
    values = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("${a}"))
    cases = {"x ${a} y": "x 1 y", "${a}${b}": "1${a}", "no": "no", "": "", "${c}": None, "open ${a": "open ${a", "$ {a} }": "$ {a} }"}
    for template, want in cases.items():
        assert spark.range(1).select(st.substitute(F.lit(template), values)).first()[0] == want, template
    assert spark.range(1).select(st.substitute(F.lit(None).cast("string"), values)).first()[0] is None


def test_descriptors(spark):
    xml = "<ejb-jar><enterprise-beans><session><ejb-name>S</ejb-name><ejb-class>a.S</ejb-class><home> a.H </home><remote/></session></enterprise-beans></ejb-jar>"
    beans = st.descriptor_beans(spark.createDataFrame([(xml,), (None,), ("",), ("<a>",)], "text string"))
    assert [(r.bean_type, r.name, r.bean_class) for r in beans.collect()] == [("session", "S", "a.S")]
    assert sorted(map(tuple, st.descriptor_edges(beans).collect())) == [("a.S", "a.H", "ejb_home"), ("a.S", "a.H", "implements")]


def test_words_of_names(spark):
    names = spark.createDataFrame([(x,) for x in ("A_SVC", "A_SERVICE", "B_MGMT", "A_MANAGEMENT", "a_svc")], "name string")
    assert [tuple(r) for r in tg.pattern_pairs(names, any_case=False).collect()] == [("A_SERVICE", "A_SVC")]
    assert spark.range(1).select(tg.normal_name(F.lit("EJB.Usage_detecte-Services12"))).first()[0] == "ejbs"


def test_reach_counts_equal_the_closure(spark, monkeypatch):
    monkeypatch.setattr(cp, "BITMAP", 7)  # many partitions of numbers
    e = [(i, (i * 7 + 3) % 60) for i in range(60)] + [(i, i + 1) for i in range(100, 130)] + [(100, 3), (5, 5)]
    edges = spark.createDataFrame([(f"n{a}", f"n{b}", "uses") for a, b in e], "source_id string, target_id string, edge_type string")
    nodes = edges.selectExpr("explode(array(source_id, target_id)) id").distinct().union(spark.createDataFrame([("alone",)], "id string"))
    got = sorted(map(tuple, cp.transitive_coupling(nodes, edges, None).collect()))
    assert got == sorted(map(tuple, cp.transitive_coupling(nodes, edges, None, "frontier").collect()))
    assert ("alone", 0, 0) in got


def test_deep_inheritance(spark):
    n = spark.range(2500).selectExpr("cast(id as string) id")
    p = spark.range(1, 2500).selectExpr("cast(id as string) id", "cast(id - 1 as string) parent")
    got = {r.id: (r.depth, r.root) for r in cp.inheritance(n, p).collect()}
    assert got["2499"] == (2499, "0") and got["0"] == (0, "0")
    loop = cp.inheritance(n, p.union(spark.createDataFrame([("0", "7")], "id string, parent string"))).collect()
    assert all(r.root is None for r in loop)
