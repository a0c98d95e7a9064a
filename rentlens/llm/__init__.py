"""Operators for training data: classifiers, deduplication, decontamination, tokens, pages, chats."""
