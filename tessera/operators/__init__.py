"""Operators that need more than one DataFrame call: plans, nested data, windows."""
