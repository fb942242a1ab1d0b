"""A PySpark engine from marked-up text to cited answers."""
