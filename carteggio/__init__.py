"""Spark-native analytics for message archives and text corpora.

Sub-packages: ``sources`` (readers and sinks), ``functions`` (column
expressions), ``operators`` (DataFrame -> DataFrame), ``plans`` (registered
queries with their SQL), ``streaming`` (incremental forms), ``llm`` (optional
training-data operators, which nothing else imports).
"""
