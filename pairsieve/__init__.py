"""pairsieve: curation, audit and evaluation analytics for preference data on Spark."""
