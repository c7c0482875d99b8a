"""Whole plans: the made-up corpus, the registered queries with their SQL, the pipeline of steps."""
