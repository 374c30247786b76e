"""Analytics over source trees, pages and text collections, as Spark DataFrames."""
