"""Operators of a training-data pipeline over the tables ``documents`` and
``conversations``. Nothing else in the library imports this subpackage."""
