"""sensorframe — sensor time-series exploration and replication on Spark.

Every operator is a function ``DataFrame -> DataFrame`` built from Spark SQL
built-ins, so Catalyst sees the whole plan (pushdown, pruning, AQE).
"""

from sensorframe.session import build_session, work_dir

__all__ = ["build_session", "work_dir"]
