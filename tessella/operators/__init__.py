"""DataFrame operators: inverted index, ranked search, visual words, fusion."""
