"""A property-graph and text analytics engine on PySpark DataFrames."""
