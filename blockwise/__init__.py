"""blockwise — survey-effort analytics on Spark DataFrames.

Every public operator is a plain function from DataFrames (plus column names
and parameters) to a DataFrame. Nothing is collected to the driver inside an
operator; see README.md for the NULL/NaN/tie rules.
"""

__version__ = "0.1.0"
