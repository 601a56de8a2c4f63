"""Column expressions over texts, arrays of sentences and arrays of scores."""
