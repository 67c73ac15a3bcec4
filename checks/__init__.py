"""Query registry: Spark queries on the driver tables and their SQL twins."""
