"""Training-data operators: scoring, decontamination, deduplication, mixing,
archives, classification, search and license scans on Spark.

Nothing outside this folder imports it.
"""
