"""Context analytics over large bodies of text, declared as Spark DataFrames."""
