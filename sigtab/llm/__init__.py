"""Operators for preparing training text; their registered queries are in ``queries``."""
