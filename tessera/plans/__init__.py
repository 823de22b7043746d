"""Registered queries and the session interface."""
