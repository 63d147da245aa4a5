"""Registered queries of the engine over the driver tables, and their SQL."""
