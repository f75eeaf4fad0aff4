"""querymill: text-to-SQL corpora, rewards and evaluation as Spark jobs."""
