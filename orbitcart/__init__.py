"""orbitcart: customer analytics for retail order data, written as Spark DataFrame operators.

Every operator is a function from DataFrames (plus plain parameters) to a DataFrame.
Nothing is collected to the driver except bounded scalars (counts, quantile edges) and
small model summaries; Catalyst plans each query as a whole.
"""

__version__ = "0.1.0"
