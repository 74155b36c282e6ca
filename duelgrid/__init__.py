"""Pairwise evaluation analytics on Spark: judge texts to preferences, summaries, ratings and leaderboards."""
