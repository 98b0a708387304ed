"""Operators over document texts for training corpora. Nothing outside this subpackage imports it."""
