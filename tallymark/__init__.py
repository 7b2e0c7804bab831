"""Spark-native analytics for evaluating models on labelled document sets.

Data lives in DataFrames; operators return lazy DataFrames and leave physical
planning to Catalyst. ``tallymark.llm`` holds the training-data operators and is
imported by nothing else in the package.
"""

__version__ = "0.1.0"
