"""Corpus preparation operators for training data. Nothing outside this folder imports it."""
