"""Training-data operators: dedup, PII, language, tokens, quality, chat, decontamination, secrets.

Nothing outside this subpackage imports it.
"""
