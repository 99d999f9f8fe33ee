"""Tables and aggregates: postings, dictionary, grams, key-value."""
