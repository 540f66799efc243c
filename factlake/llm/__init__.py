"""Operators of a training-data pipeline (see the README's section on ``llm``).

Nothing else in the library imports this subpackage; the driver entry adds its
queries only where it is present.
"""
