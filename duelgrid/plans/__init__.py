"""Run-level pieces: prompts, configuration, baselines, inference, caches, run records and the end-to-end pipelines."""
