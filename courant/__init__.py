"""News and market briefings as Spark jobs: DataFrame in, DataFrame out."""
