"""Scalar functions as column expressions; a Python worker only where no expression can."""
