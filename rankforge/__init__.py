"""rankforge: document retrieval and ranking analytics on Spark."""
