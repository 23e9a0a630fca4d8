"""Operators for training-data pipelines; nothing else in lexloom imports this subpackage."""
