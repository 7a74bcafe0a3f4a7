"""Operators of a training-data pipeline: quality, duplicates, contamination, tokens, toxicity, personal data, licences, urls, chats."""
