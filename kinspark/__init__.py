"""kinspark: genetic-genealogy analytics as Spark DataFrame operators."""
