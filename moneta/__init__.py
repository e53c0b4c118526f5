"""moneta: personal-finance analytics as Spark DataFrame operators.

Every operator is a plain ``DataFrame -> DataFrame`` function.  Statistics
that the single-user original computes over "the whole batch" are computed
per key here (``keys=("user_id",)`` by default; ``keys=()`` reproduces the
one-batch behaviour).
"""

__version__ = "0.1.0"
