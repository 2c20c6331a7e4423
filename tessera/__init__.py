"""A PySpark-native analytics engine: fluent plans, Presto-flavoured SQL and catalog tools over DataFrames."""
