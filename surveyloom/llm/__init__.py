"""Operators of a training-data pipeline: cleaning, duplicate removal, filtering, encoding and packing of documents."""
