"""DataFrame operators: preparation, statistics, reports, scores and findings."""
