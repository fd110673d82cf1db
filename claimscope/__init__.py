"""claimscope: claim-spread analytics and corpus preparation, expressed as Spark plans.

Every operator is a function of DataFrames (and an explicit ``as_of`` where time
matters) that returns a DataFrame, so Catalyst sees the whole plan.
"""

__version__ = "0.1.0"
