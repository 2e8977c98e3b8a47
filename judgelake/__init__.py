"""judgelake: bulk judging analytics and dataset curation on Spark.

Run logs, problem registries and curation inputs are DataFrames; every
operator is a DataFrame -> DataFrame (or Column -> Column) function that
Catalyst plans. See README.md for the operator map.
"""

__version__ = "0.1.0"
