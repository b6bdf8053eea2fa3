"""loomdex: web-corpus indexing, ranked search and crawl analytics as Spark DataFrames."""
