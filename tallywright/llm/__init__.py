"""Text operators for training data and record matching, with their queries; nothing outside this folder imports it."""

from tallywright.llm.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
