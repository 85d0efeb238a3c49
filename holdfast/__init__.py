"""Customer retention analytics as column-parameterised Spark DataFrame functions."""

__version__ = "0.1.0"
