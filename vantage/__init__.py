"""vantage: as-of knowledge-graph analytics and corpus jobs as Spark DataFrame operators."""
