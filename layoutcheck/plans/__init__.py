"""Rule decks and the catalogue of queries."""
