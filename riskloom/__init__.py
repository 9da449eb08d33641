"""Order risk and margin analytics as Spark DataFrame jobs.

Every operator takes DataFrames and returns a DataFrame (or a Column).  Nothing
here keeps a global session, and nothing moves rows to the driver beyond
one-row policies and fitted model metadata.
"""
