"""Operators composed into the jobs a user runs."""
