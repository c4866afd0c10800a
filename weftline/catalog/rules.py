"""Rule planning, detectors and exports of the rule graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.catalog import query
from weftline.operators import tags as tg
from weftline.plans import structure as st
from weftline.plans.detectors import FEATURES, detect
from weftline.plans.rules import Rule, apply_rules, dependency_frames, levels

RULES = (
    Rule("priority", "metrics['acctbal'] > 9000", produces=("priority",), requires=("wealthy", "building"), metrics={"score": "metrics['acctbal'] / 100"}),
    Rule("wealthy", "metrics['acctbal'] > 7000", produces=("wealthy",), requires=("rich",)),
    Rule("watch", "metrics['acctbal'] < 100", produces=("watch", "small")),
    Rule("bulky", "metrics['size'] >= 45 and properties['brand'] is not null", produces=("bulky",), requires=("large",), metrics={"score": "metrics['size'] * 2", "seen": "1"}),
)


@query(
    "rule_tagging",
    """WITH a AS (SELECT id, tags, metrics, properties, metrics['acctbal'] AS b, metrics['size'] AS z FROM nodes),
w AS (SELECT *, list_contains(tags, 'rich') AND coalesce(b > 7000, false) AS wealthy, coalesce(b < 100, false) AS watch, list_contains(tags, 'large') AND coalesce(z >= 45, false) AS bulky FROM a),
p AS (SELECT *, wealthy AND list_contains(tags, 'building') AND b > 9000 AS priority FROM w)
SELECT id, array_to_string(list_sort(list_distinct(tags || CASE WHEN wealthy THEN ['wealthy'] ELSE [] END || CASE WHEN watch THEN ['watch', 'small'] ELSE [] END || CASE WHEN bulky THEN ['bulky'] ELSE [] END || CASE WHEN priority THEN ['priority'] ELSE [] END)), ',') AS tags,
CASE WHEN priority THEN b / 100 WHEN bulky THEN z * 2 END AS score FROM p""",
)
def _(t):
    return apply_rules(t.nodes, RULES).select("id", F.array_join("tags", ",").alias("tags"), F.col("metrics")["score"].alias("score"))


@query("rule_levels", "SELECT * FROM (VALUES ('bulky', 0), ('watch', 0), ('wealthy', 0), ('priority', 1)) AS v(rule, level)")
def _(t):
    return t.spark.createDataFrame([(r.name, i) for i, g in enumerate(levels(RULES)) for r in g], "rule string, level int")


@query("rule_dependencies", "SELECT 'wealthy' AS producer, 'priority' AS consumer, 'wealthy' AS tags")
def _(t):
    return tg.producers_consumers(*dependency_frames(t.spark, RULES))


_AGGS = {f: (i % 9 + 2, i % 5) for i, f in enumerate(FEATURES)}
_FEATURE_SQL = ", ".join(f"(count(*) FILTER (l_partkey % {m} = {r} AND l_quantity < {4 + r}))::INT % 27 AS {f}" for f, (m, r) in _AGGS.items())


def _features(t):
    """Feature counts of every supplier, from its lines."""
    l = t["lineitem"]
    cols = [(F.count_if((F.col("l_partkey") % m == r) & (F.col("l_quantity") < 4 + r)).cast("int") % 27).alias(f) for f, (m, r) in _AGGS.items()]
    return l.groupBy(F.col("l_suppkey").alias("id")).agg(*cols, (F.count("*") % 2 == 0).alias("is_service"))


_DETECTED = f"""WITH f AS (SELECT l_suppkey AS id, {_FEATURE_SQL}, count(*) % 2 = 0 AS is_service FROM lineitem GROUP BY 1), x AS (
  SELECT *, CASE WHEN connections + statements + result_sets > 0 THEN 2 ELSE 0 END + connections + statements + result_sets + (manual_mappings > 0)::INT * 3 + queries AS jdbc_points,
    CASE WHEN delegates > 0 THEN 1 + CASE WHEN methods > 5 THEN 2 WHEN methods > 2 THEN 1 ELSE 0 END ELSE 0 END + (locators > 0)::INT * 2 + (uses_locator > 0)::INT + CASE WHEN lookups > 3 THEN 2 WHEN lookups > 1 THEN 1 ELSE 0 END AS delegate_points
  FROM f), h AS (
  SELECT id, 'dao' AS rule, NULL::VARCHAR AS level FROM x WHERE jdbc > 0 OR (crud > 0 AND entities > 0)
  UNION ALL SELECT id, 'dto', if(setters > 0, 'MUTABLE', 'IMMUTABLE') FROM x WHERE getters + setters > 0 AND getters + setters > 0.7 * methods
  UNION ALL SELECT id, 'utility_helper', NULL FROM x WHERE static_methods > 0 AND (static_methods > 0.7 * methods OR private_constructors > 0 OR (constructors = 0 AND state_fields = 0))
  UNION ALL SELECT id, 'utility_class', if(methods > 20, 'HIGH', if(methods > 10, 'MEDIUM', 'LOW')) FROM x WHERE static_methods = methods AND fields = 0 AND methods >= 3 AND (private_constructors > 0 OR (constructors = 0 AND utility_name > 0))
  UNION ALL SELECT id, 'mutable_service', if(state_fields > 3, 'HIGH', 'LOW') FROM x WHERE is_service AND state_fields > 0
  UNION ALL SELECT id, 'exception_antipattern', if(violations > 10, 'HIGH', if(violations > 5, 'MEDIUM', 'LOW')) FROM x WHERE violations > 0
  UNION ALL SELECT id, 'stateful_state', CASE WHEN 2 * state_fields + 3 * cross_dependencies <= 8 THEN 'LOW' WHEN 2 * state_fields + 3 * cross_dependencies <= 16 THEN 'MEDIUM' WHEN 2 * state_fields + 3 * cross_dependencies <= 24 THEN 'HIGH' ELSE 'CRITICAL' END FROM x WHERE state_fields > 0
  UNION ALL SELECT id, 'complex_relations', if(relations >= 5, 'HIGH', if(relations >= 2, 'MEDIUM', 'LOW')) FROM x WHERE relations > 0
  UNION ALL SELECT id, 'rest_service', if(endpoints > 15, 'HIGH', if(endpoints > 8, 'MEDIUM', 'LOW')) FROM x WHERE endpoints > 0
  UNION ALL SELECT id, 'rest_complexity', if(endpoints > 15, '9.0', if(endpoints > 8, '6.', '3.') || if(verbs > 3, '5', '0')) FROM x WHERE endpoints > 0
  UNION ALL SELECT id, 'soap_service', if(operations > 10, 'HIGH', if(operations > 5, 'MEDIUM', 'LOW')) FROM x WHERE operations > 0
  UNION ALL SELECT id, 'jndi_lookup', if(lookups > 10, 'HIGH', if(lookups > 5, 'MEDIUM', 'LOW')) FROM x WHERE lookups > 0
  UNION ALL SELECT id, 'transaction_script', NULL FROM x WHERE transactions > 0
  UNION ALL SELECT id, 'service_locator', NULL FROM x WHERE lookups > 0 OR factories > 1
  UNION ALL SELECT id, 'factory_bean', NULL FROM x WHERE factories > 1 OR (factories > 0 AND creates > 0) OR factory_name > 0
  UNION ALL SELECT id, 'timer', NULL FROM x WHERE timers > 0 OR timer_creates > 0
  UNION ALL SELECT id, 'create_use', if(creates > 3, 'HIGH', if(creates > 1, 'MEDIUM', 'LOW')) FROM x WHERE creates > 0
  UNION ALL SELECT id, 'create_score', if(2 + creates + create_patterns + lookups + 2 * (creates_with_db + unmatched_creates) <= 5, 'LOW', if(2 + creates + create_patterns + lookups + 2 * (creates_with_db + unmatched_creates) <= 12, 'MEDIUM', 'HIGH')) FROM x WHERE creates > 0
  UNION ALL SELECT id, 'field_mapping', if(3 + fields + 2 * relations + (key_fields > 1)::INT * 3 <= 5, 'LOW', if(3 + fields + 2 * relations + (key_fields > 1)::INT * 3 <= 10, 'MEDIUM', 'HIGH')) FROM x WHERE fields > 0
  UNION ALL SELECT id, 'server_config', if(config_features >= 4, 'HIGH', if(config_features >= 2, 'MEDIUM', 'LOW')) FROM x WHERE config_features > 0
  UNION ALL SELECT id, 'jdbc_pattern', CASE WHEN if(data_access > 0, greatest(1, jdbc_points - 2), jdbc_points) <= 3 THEN 'LOW' WHEN if(data_access > 0, greatest(1, jdbc_points - 2), jdbc_points) <= 8 THEN 'MEDIUM' ELSE 'HIGH' END FROM x WHERE jdbc > 0
  UNION ALL SELECT id, 'business_delegate', if(delegate_points <= 2, 'LOW', if(delegate_points <= 5, 'MEDIUM', 'HIGH')) FROM x WHERE delegates + locators > 0
)"""


@query("rule_detectors", _DETECTED + " SELECT id, rule, level FROM h")
def _(t):
    return detect(_features(t))


@query("detector_counts", _DETECTED + " SELECT rule, level, count(*) AS classes FROM h GROUP BY 1, 2")
def _(t):
    return detect(_features(t)).groupBy("rule", "level").agg(F.count("*").alias("classes"))


@query(
    "data_transfer",
    f"""WITH f AS (SELECT l_suppkey AS id, {_FEATURE_SQL} FROM lineitem GROUP BY 1), s AS (
  SELECT id, CASE WHEN is_dto > 0 AND fields > 10 THEN 3 WHEN is_dto > 0 AND fields > 5 THEN 2 WHEN is_dto > 0 THEN 1 ELSE 0 END + CASE WHEN value_object > 0 AND immutable > 0 THEN 2 WHEN value_object > 0 THEN 1 ELSE 0 END
    + CASE WHEN mapping_methods > 3 THEN 3 WHEN mapping_methods > 0 THEN 2 ELSE 0 END + CASE WHEN row_mappings > 0 AND row_calls > 10 THEN 4 WHEN row_mappings > 0 AND row_calls > 5 THEN 3 WHEN row_mappings > 0 THEN 2 ELSE 0 END + (jdbc > 0)::INT AS score
  FROM f WHERE is_dto > 0 OR value_object > 0 OR mapping_methods > 0 OR row_mappings > 0)
SELECT id, score::INT AS score, if(score <= 3, 'LOW', if(score <= 7, 'MEDIUM', 'HIGH')) AS level FROM s""",
)
def _(t):
    return st.data_transfer(_features(t))


@query("name_match", "SELECT tag, min(levenshtein(tag, 'negativ'))::INT AS distance FROM (SELECT DISTINCT unnest(tags) AS tag FROM nodes) GROUP BY 1 ORDER BY 2, 1 LIMIT 2")
def _(t):
    """Known tags closest to a free name."""
    known = tg.tag_rows(t.nodes).select("tag").distinct()
    return known.select("tag", F.levenshtein("tag", F.lit("negativ")).alias("distance")).orderBy("distance", "tag").limit(2)
