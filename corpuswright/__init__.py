"""Corpus building, labelling, splitting and scoring as Spark DataFrame operators."""
