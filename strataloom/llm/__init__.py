"""Operators for text of language-model training corpora. Nothing outside this subpackage imports it."""
