"""Operators for preparing training text at scale.

Nothing outside this subpackage imports it; the entry file adds its queries
only when it is there.
"""
