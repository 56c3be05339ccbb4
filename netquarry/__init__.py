"""Detection engineering over network sensor telemetry, expressed as PySpark DataFrame jobs.

``sources``   reading lines, normalising and ingesting them, registries, labelled cases
``functions`` Column expressions: addresses, text, time, DNS names, scores, Markdown
``operators`` DataFrame-in / DataFrame-out relational work: joins, windows, rules, cases
``streaming`` Structured Streaming forms
``plans``     the registered queries over the supplied tables, with their SQL twins
"""

__version__ = "0.1.0"
