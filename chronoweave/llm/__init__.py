"""Operators for training data of language models; nothing outside this subpackage imports it."""
