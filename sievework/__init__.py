"""Applicant, conversation and training-data operators on PySpark DataFrames."""
