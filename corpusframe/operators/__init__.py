"""Operators over DataFrames: filters, scoring, ranking, chunking, code intelligence, history."""
