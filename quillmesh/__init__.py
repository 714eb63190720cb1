"""Corpus preparation, formula scoring and answer grading as Spark DataFrame jobs."""
