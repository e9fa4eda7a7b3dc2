"""winnow: triage of static-analysis findings as Spark jobs.

Public functions take and return DataFrames; nothing is collected on the driver.
"""

__version__ = "0.1.0"
