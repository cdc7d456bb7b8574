"""Reporting-compliance analytics for study registers, written for Spark.

Every operator takes DataFrames and returns a DataFrame.  See the sub-packages:

``functions``  column expressions
``sources``    scans, sinks, upserts and the test-bed views
``operators``  joins, rollups, classification, cohorts, models, browsing
``plans``      whole pipelines and the catalogue of registered queries
``streaming``  the record stream
"""
