"""Analytics over application packages, traces and text corpora, as Spark DataFrame operators."""
