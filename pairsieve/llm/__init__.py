"""Operators for large training-data pipelines of language models; nothing else imports this."""
