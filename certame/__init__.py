"""Analytics for multiple-choice exam banks as Spark DataFrame operators."""
