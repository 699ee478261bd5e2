"""Analytics on mails and large text corpora, expressed in PySpark."""
