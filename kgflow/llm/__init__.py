"""Operators for preparing large text corpora (sharding, token counts, nearest
neighbours, decontamination, quality, de-duplication, filters, mixing,
language).  Nothing outside this package imports it."""
