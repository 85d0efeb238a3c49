"""Registered queries, their independent SQL, and the comparison of both."""
