"""tempora: point-in-time analytics over (entity, date) tables, planned by Spark.

Every operator takes DataFrames and returns DataFrames.  Nothing in the package
triggers an action except the sinks and the two functions that say so
(`validate_or_raise` and `costed_nav_path`).
"""

__version__ = "0.1.0"
