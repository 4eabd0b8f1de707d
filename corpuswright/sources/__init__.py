"""Readers and writers. Readers are lazy and take explicit schemas; writers use Spark's committers."""
