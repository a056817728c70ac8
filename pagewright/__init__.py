"""Pagewright: a DataFrame-first analytics engine for collections of typed text pages."""

__version__ = "0.1.0"
