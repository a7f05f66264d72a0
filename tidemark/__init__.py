"""Belief-and-record analytics as Spark DataFrame programs."""
