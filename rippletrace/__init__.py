"""Change-impact analytics on Spark, with a sub-package of training-data operators."""
