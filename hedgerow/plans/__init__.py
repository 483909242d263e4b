"""Policies as relations, and their application with joins."""
