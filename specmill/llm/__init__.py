"""Text-corpus operators on catalogue records: each takes records with ``id`` and ``description`` and runs on Spark."""
