"""Folioscope: document-compliance analytics and training-data preparation on Apache Spark.

Every operator is a function from DataFrames to a DataFrame.  Nothing is executed before an
action, unless an operator's docstring says that it takes statistics first.
"""

__version__ = "0.1.0"
