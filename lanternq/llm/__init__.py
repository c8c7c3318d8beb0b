"""Training-data operators.

Nothing outside this subpackage imports it; ``__spark_entry__`` adds
``entries.QUERIES`` only where the subpackage is present.
"""
