"""Catalog intelligence jobs as PySpark DataFrame operators.

The package is organised the way a Spark user reads a job:

``functions``   column expressions (keys, urls, text, hashes)
``sources``     readers and writers
``operators``   DataFrame -> DataFrame jobs
``streaming``   Structured Streaming versions of the intake and the counters
``plans``       the operators bound to the driver's tables, with their oracle SQL
"""
