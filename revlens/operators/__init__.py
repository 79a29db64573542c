"""DataFrame operators: deduplication, quotas, labelling, reports, trends, sampling and models."""
