"""Batch analytics for biogas supply, plants and projects on Spark.

Operators are functions from DataFrames to DataFrames.  ``sucrogas.operators`` holds
the relational and numeric operators, ``sucrogas.functions`` the scalar ones,
``sucrogas.sources`` readers and sinks, ``sucrogas.plans`` the registered queries
with their SQL twins and ``sucrogas.streaming`` the incremental forms.
"""

__version__ = "0.1.0"
