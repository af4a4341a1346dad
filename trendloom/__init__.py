"""trendloom: topic-trend and corpus analytics declared as Spark plans."""
