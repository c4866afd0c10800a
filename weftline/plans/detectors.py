"""Detectors as declarative rules over a table of features.

Features come from whoever extracts them (parsers stay outside an analytics engine); a
detector is a condition and, for some, a level. All of them run in one projection.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Detector:
    name: str
    condition: str
    level: str = "NULL"


def _tiers(x: str, *steps: tuple[int, str], low: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} > {n} THEN '{label}'" for n, label in steps) + f" ELSE '{low}' END"


def _steps(x: str, *steps: tuple[int, str], top: str) -> str:
    return "CASE " + " ".join(f"WHEN {x} <= {n} THEN '{label}'" for n, label in steps) + f" ELSE '{top}' END"


_STATE = "(state_fields * 2 + cross_dependencies * 3)"
_CREATE = "(2 + creates + create_patterns + lookups + 2 * creates_with_db + 2 * unmatched_creates)"
_MAPPING = "(3 + fields + 2 * relations + CASE WHEN key_fields > 1 THEN 3 ELSE 0 END)"
_JDBC = "(CASE WHEN connections + statements + result_sets > 0 THEN 2 ELSE 0 END + connections + statements + result_sets + CASE WHEN manual_mappings > 0 THEN 3 ELSE 0 END + queries)"
_JDBC = f"(CASE WHEN data_access > 0 THEN greatest(1, {_JDBC} - 2) ELSE {_JDBC} END)"
_DELEGATE = "(CASE WHEN delegates = 0 THEN 0 WHEN methods > 5 THEN 3 WHEN methods > 2 THEN 2 ELSE 1 END + CASE WHEN locators > 0 THEN 2 ELSE 0 END + CASE WHEN uses_locator > 0 THEN 1 ELSE 0 END + CASE WHEN lookups > 3 THEN 2 WHEN lookups > 1 THEN 1 ELSE 0 END)"
# levels as numbers: LOW 3, MEDIUM 6, HIGH 9; more than three verbs add a half
_REST = "least(9.0, CASE WHEN endpoints > 15 THEN 9.0 WHEN endpoints > 8 THEN 6.0 ELSE 3.0 END + CASE WHEN verbs > 3 THEN 0.5 ELSE 0.0 END)"

# Conditions and thresholds of the detectors.
DETECTORS = (
    Detector("dao", "jdbc > 0 OR (crud > 0 AND entities > 0)"),
    Detector("dto", "getters + setters > 0 AND (getters + setters) * 10 > methods * 7", "CASE WHEN setters > 0 THEN 'MUTABLE' ELSE 'IMMUTABLE' END"),
    Detector("utility_helper", "static_methods > 0 AND (static_methods * 10 > methods * 7 OR private_constructors > 0 OR (constructors = 0 AND state_fields = 0))"),
    Detector("utility_class", "static_methods = methods AND fields = 0 AND methods >= 3 AND (private_constructors > 0 OR (constructors = 0 AND utility_name > 0))", _tiers("methods", (20, "HIGH"), (10, "MEDIUM"), low="LOW")),
    Detector("mutable_service", "is_service AND state_fields > 0", _tiers("state_fields", (3, "HIGH"), low="LOW")),
    Detector("exception_antipattern", "violations > 0", _tiers("violations", (10, "HIGH"), (5, "MEDIUM"), low="LOW")),
    Detector("stateful_state", "state_fields > 0", _steps(_STATE, (8, "LOW"), (16, "MEDIUM"), (24, "HIGH"), top="CRITICAL")),
    Detector("complex_relations", "relations > 0", "CASE WHEN relations >= 5 THEN 'HIGH' WHEN relations >= 2 THEN 'MEDIUM' ELSE 'LOW' END"),
    Detector("rest_service", "endpoints > 0", _tiers("endpoints", (15, "HIGH"), (8, "MEDIUM"), low="LOW")),
    Detector("rest_complexity", "endpoints > 0", _REST),
    Detector("soap_service", "operations > 0", _tiers("operations", (10, "HIGH"), (5, "MEDIUM"), low="LOW")),
    Detector("jndi_lookup", "lookups > 0", _tiers("lookups", (10, "HIGH"), (5, "MEDIUM"), low="LOW")),
    Detector("transaction_script", "transactions > 0"),
    Detector("service_locator", "lookups > 0 OR factories > 1"),
    Detector("factory_bean", "factories > 1 OR (factories > 0 AND creates > 0) OR factory_name > 0"),
    Detector("timer", "timers > 0 OR timer_creates > 0"),
    Detector("create_use", "creates > 0", _tiers("creates", (3, "HIGH"), (1, "MEDIUM"), low="LOW")),
    Detector("create_score", "creates > 0", _steps(_CREATE, (5, "LOW"), (12, "MEDIUM"), top="HIGH")),
    Detector("field_mapping", "fields > 0", _steps(_MAPPING, (5, "LOW"), (10, "MEDIUM"), top="HIGH")),
    Detector("server_config", "config_features > 0", "CASE WHEN config_features >= 4 THEN 'HIGH' WHEN config_features >= 2 THEN 'MEDIUM' ELSE 'LOW' END"),
    Detector("jdbc_pattern", "jdbc > 0", _steps(_JDBC, (3, "LOW"), (8, "MEDIUM"), top="HIGH")),
    Detector("business_delegate", "delegates + locators > 0", _steps(_DELEGATE, (2, "LOW"), (5, "MEDIUM"), top="HIGH")),
)
FEATURES = ("jdbc", "crud", "entities", "getters", "setters", "methods", "static_methods", "fields", "state_fields", "cross_dependencies", "violations", "relations", "endpoints", "operations", "lookups", "transactions", "factories", "timers", "creates", "create_patterns", "creates_with_db", "unmatched_creates", "key_fields", "config_features", "connections", "statements", "result_sets", "manual_mappings", "queries", "delegates", "locators", "private_constructors", "constructors", "utility_name", "verbs", "factory_name", "timer_creates", "data_access", "uses_locator", "is_dto", "value_object", "immutable", "mapping_methods", "row_mappings", "row_calls")


def detect(features: DataFrame, id_col: str = "id", detectors=DETECTORS) -> DataFrame:
    """(id, rule, level) of every detector that fires; features: FEATURES as integers and is_service."""
    fired = F.array(*(F.when(F.expr(d.condition), F.struct(F.lit(d.name).alias("rule"), F.expr(d.level).cast("string").alias("level"))) for d in detectors))
    return features.select(F.col(id_col).alias("id"), F.explode(F.array_compact(fired)).alias("r")).select("id", "r.rule", "r.level")
