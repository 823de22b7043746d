"""Runnable jobs: each module has a function that takes a session, a small config file beside it, and a command line."""
