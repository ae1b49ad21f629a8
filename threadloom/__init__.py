"""threadloom: a Spark-first library for corpora of chat transcripts.

The package reads JSONL transcripts (or ready-made message and turn tables),
folds them into conversation tables and answers ranked queries over them. Every
operator takes and returns DataFrames; nothing in this package collects a corpus
to the driver.
"""

__version__ = "0.1.0"
