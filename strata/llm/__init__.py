"""Operators of a training-data pipeline: mixing, packing, quality, language, sharding, near duplicates, media, scoring, privacy."""
