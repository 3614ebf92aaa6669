"""Derived relations and the query registry."""
