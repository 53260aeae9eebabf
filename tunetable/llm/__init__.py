"""Operators of a training-data pipeline, one module each.

The package stands alone: nothing else in the library imports it, and it takes
from the library only the session helpers. ``queries`` holds what the driver
registers.
"""
