"""Operators for building language-model training data on Spark.

Nothing else in the library imports this subpackage.  ``queries`` registers one
thin query per operator; every operator module has its own general interface.
"""
