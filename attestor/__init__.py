"""Attestor: Spark operators that audit how registered studies were reported.

Every operator takes DataFrames (or Columns) and returns DataFrames (or Columns); rule tables and
thresholds are parameters whose defaults live in :mod:`attestor.presets`.
"""

__version__ = "0.1.0"
