"""Spark jobs for chronological, two-sided contests: cleaning, leakage-safe
features, ratings, goal and outcome models, evaluation, calibration, entity and
intent tagging, and live snapshots. Everything is DataFrame in, DataFrame out."""
