"""Operators for training-data pipelines; nothing else in Tessera imports this subpackage."""
