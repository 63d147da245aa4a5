"""Runnable jobs; each file has a command line and a small settings file beside it."""
