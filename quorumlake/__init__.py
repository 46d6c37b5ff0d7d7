"""Mining and corroborating knowledge graphs on Spark: triples become facts, facts are verified by independent domains."""
