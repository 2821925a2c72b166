"""regspark: Spark-native loading, cleaning and joining of sharded company-registry snapshots.

Every operator takes and returns DataFrames; nothing on the data path is collected to
the driver.  Subpackages:

* ``sources``    readers for delimited shards, snapshots, zip archives and link pages
* ``functions``  column expressions (key prefixes, names, links, cleaning)
* ``operators``  dedup, joins, counts, manifests, dimensions
* ``sinks``      Parquet / CSV writers, conversion jobs, previews, schema reports
* ``streaming``  incremental pickup of newly landed shards
* ``plans``      the end-to-end company → establishment → partner join
"""

from regspark.schemas import Dialect, EMPRE_COLUMNS, ESTA_COLUMNS, SOCIOS_COLUMNS

__all__ = ["Dialect", "EMPRE_COLUMNS", "ESTA_COLUMNS", "SOCIOS_COLUMNS"]
