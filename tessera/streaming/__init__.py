"""Batch and streaming event windows (an extension; plans are batch only)."""
