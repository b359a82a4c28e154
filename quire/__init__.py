"""quire: document conversion and summary planning as Spark DataFrames."""
