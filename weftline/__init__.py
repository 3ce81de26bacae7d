"""weftline: incremental document processing as lazy Spark DataFrame transformations."""
