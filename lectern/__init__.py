"""Evidence retrieval over versioned corpora of short citable texts, on Spark."""
