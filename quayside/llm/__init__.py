"""Operators of a training-data pipeline.

Nothing else in the library imports this subpackage.  Each operator is a
function from DataFrame to DataFrame that names its columns by parameter and
reads no other column, so extra columns with clashing names never matter.
"""
