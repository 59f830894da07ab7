"""tessel: code-surface analytics on Spark, plus training-data operators in ``tessel.llm``."""
