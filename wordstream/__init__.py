"""wordstream: decoding and time correlation of detector word streams on Spark."""

__version__ = "0.1.0"
