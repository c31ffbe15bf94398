"""Operators for preparing training corpora. Nothing else in the library imports this subpackage."""
