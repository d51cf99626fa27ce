"""DataFrame operators: joins, grouping, windows and models over transcripts."""
