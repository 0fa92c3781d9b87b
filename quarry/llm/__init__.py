"""Operators for large training-text pipelines.

Nothing else in the library imports this subpackage; its queries are added
to the registry by the driver module only when it can be imported.
"""
