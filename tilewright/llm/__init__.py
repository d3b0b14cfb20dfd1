"""Operators of a training-data pipeline.

Nothing else in the package imports this subpackage; deleting it leaves the
rest working.  Each operator lives in a module of its own and keeps a general
interface; ``queries.py`` binds the operators to the driver's tables.
"""
