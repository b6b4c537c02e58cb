"""Spark-native analytics over tables, intervals, alignments, sequences and text.

Every operator takes DataFrames and returns a lazy DataFrame; the subpackages
are ``sources`` (readers and writers), ``functions`` (Column builders),
``operators`` (DataFrame transformations), ``plans`` (registered queries and
declarative workflows), ``streaming`` and the optional ``llm``.
"""

__version__ = "0.1.0"
