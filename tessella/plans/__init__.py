"""Query language: text to predicate."""
