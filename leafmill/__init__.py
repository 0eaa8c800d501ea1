"""leafmill: long-form text corpora on Spark, DataFrame in and DataFrame out."""
