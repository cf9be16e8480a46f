"""arbiter: answer evaluation, profiling and schema retrieval as lazy Spark jobs.

Every public operator takes DataFrames (plus plain parameters) and returns a
DataFrame.  Nothing is collected to the driver to reach a verdict; Catalyst and
adaptive query execution choose join and aggregation strategies.
"""

__version__ = "0.1.0"
