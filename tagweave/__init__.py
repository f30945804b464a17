"""tagweave: associative text retrieval as Spark plans."""
