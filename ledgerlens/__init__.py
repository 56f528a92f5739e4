"""ledgerlens: transaction analytics expressed as Spark DataFrame jobs.

Every operator takes DataFrames and returns DataFrames; nothing is collected
to the driver except one-row statistics and bounded dictionaries whose size is
checked first.
"""

__version__ = "0.1.0"
