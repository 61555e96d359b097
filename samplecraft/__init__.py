"""samplecraft: labelled-sample analytics written Spark-first.

Manifest parsing, class dictionaries, seeded sampling and batching, tensor
preprocessing, linear-head scoring and training, run-history rules and
confusion analysis, all as DataFrame -> DataFrame operators.
"""

__version__ = "0.1.0"
