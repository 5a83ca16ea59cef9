"""Whole runs and the registered queries, put together from sources and operators."""
