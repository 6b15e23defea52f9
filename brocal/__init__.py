"""brocal: a PySpark-native analytics and data-preparation engine.

Every operator is a function from DataFrames to a DataFrame.  Nothing in the
package writes or counts behind the caller's back except where a docstring
says so.
"""
