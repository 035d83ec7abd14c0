"""Training-data operators. Nothing outside this package imports it.

Modules: chat, media, decontaminate, repeats, pii, quality, language_model,
jaccard, licenses, pieces; ``queries`` registers one query per operator.
"""
