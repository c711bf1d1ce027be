"""Training-data operators: quotation linking, joins and deduplication, extraction, language
identification, mixing, secret scans and decontamination, each as a Spark job.

Nothing outside this package imports it; `registry` lists its queries and SQL twins.
"""
