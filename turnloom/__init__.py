"""Turn analytics and corpus operators, written as Spark jobs."""
