"""Source-traceability operators for Spark DataFrames.

Documents become ordered units, units become facts, claims are joined to the
sources they cite, and every check returns plain rows.
"""

__version__ = "0.1.0"
