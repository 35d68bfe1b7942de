"""Operators of a training-data pipeline: archives, tokenizers, language models, duplicates, secrets, media."""
