"""Cohort, drug-utilisation and drug-safety operators over common-data-model tables.

Every operator takes DataFrames and parameters and returns a DataFrame.
"""
