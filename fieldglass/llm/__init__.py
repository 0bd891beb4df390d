"""Operators a training-data pipeline needs: filtering, deduplication, scoring and mixing of documents."""
