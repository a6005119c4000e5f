"""Readers and writers for corpora, topics, runs and judgements."""
