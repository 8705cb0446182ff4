"""Learning on tables: preparation, models, scoring, search, attribution."""
