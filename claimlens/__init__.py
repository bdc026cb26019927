"""claimlens: health-insurance claims audit on Spark DataFrames.

Every operator takes and returns DataFrames or Columns; the heavy lifting is
left to Catalyst (pushdown, pruning, join planning) and to MLlib / Structured
Streaming where the work is model training or continuous scoring.
"""

__version__ = "0.1.0"
