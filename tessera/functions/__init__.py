"""Functions whose results differ from those of Spark of the same name."""
