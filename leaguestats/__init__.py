"""Sports-league statistics as Spark DataFrame operations.

Every public function takes and returns DataFrames (or Columns) and leaves the
physical plan to Catalyst.  See README.md for the map of modules.
"""

__version__ = "0.1.0"
