"""Operators for corpora of language models; nothing else in the library imports this subpackage."""
