"""Schemas of the graph and log frames."""

NODES = "id string, node_type string, display_label string, properties map<string,string>, metrics map<string,double>, tags array<string>, created_at timestamp, updated_at timestamp"
EDGES = "source_id string, target_id string, edge_type string, properties map<string,string>, created_at timestamp"
CALLS = "call_id string, ts timestamp, pattern string, success boolean, script_generated boolean, cache_hit boolean, matches long, duration_ms double, tokens long, cost double"
RUNS = "plan string, phase string, task string, block string, status string, started_at timestamp, completed_at timestamp, execution_time_ms long"

# The relations that count for coupling.
COUPLING_TYPES = ("extends", "implements", "uses")
DEFAULT_PACKAGE = "(default)"
EDGE_KEY = ("source_id", "target_id", "edge_type")

# JSON keeps microseconds only by a format that says so
JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"
JSON_TIME_READ = "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][.SSS][XXX]"
