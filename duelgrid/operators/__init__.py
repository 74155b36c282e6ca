"""DataFrame operators: summaries, battles, ratings, calibration, completions, two-turn judging."""
