"""Text analytics on Spark: cleaning, tokens, lexicon scores and statistics over collections of song lyrics."""
