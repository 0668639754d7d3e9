"""Runnable jobs: `python -m jobs.quality_tiles` and `python -m jobs.growing_coverage`; each has a JSON config beside it."""
