"""flipside: audits of labelled text and of the classifiers trained on it, as Spark jobs."""
