"""quadloom: a Spark-native graph query engine over RDF quads and relational tables."""
