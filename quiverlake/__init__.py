"""quiverlake: vector search and its experiment analytics as PySpark DataFrame operators."""
