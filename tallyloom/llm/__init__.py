"""Operators of a training-data pipeline: near duplicates, classifiers, rules, language model, mixing, tokens, chat, secrets, search."""
