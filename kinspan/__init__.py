"""kinspan: interval, similarity-graph, aligned-sequence and corpus operators as Spark DataFrame programs."""
