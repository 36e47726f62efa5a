"""Training-data operators: filtering, deduplication, scoring, packing and web archives.

Nothing else in the library imports this subpackage; ``__spark_entry__.py`` adds its queries when it is present.
"""
