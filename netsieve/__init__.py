"""netsieve — Spark-native analytics for labelled network flows and packet streams.

Every public function takes and returns a DataFrame (or a Column); the work is
declared with the DataFrame API so Catalyst can prune, push down and plan it.
"""

from netsieve.session import get_spark, scratch_dir, table

__all__ = ["get_spark", "scratch_dir", "table"]
