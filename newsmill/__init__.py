"""newsmill: a Spark-native engine for news-content pipelines.

Every operator is a function from DataFrames to DataFrames, written with the DataFrame/SQL API so that
Catalyst and Tungsten choose the physical plan.  The subpackage ``llm`` holds the operators for training
data; nothing outside it imports it.
"""
