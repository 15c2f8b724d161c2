"""labelset: label-set evaluation on Spark DataFrames.

Ingest messy JSON replies, normalise and canonicalise labels against a controlled
vocabulary, compare predicted and gold sets per key, and report precision, recall, F1,
MCC, NPV and FDR per key, per group (macro) and in total; plus group-wise regressions.
"""

__version__ = "0.1.0"
