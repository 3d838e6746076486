"""threadmill: Spark-native operators for short-post corpora.

Posts and reply threads go in; cleaned, labelled, tokenised and encoded
training tables come out. Every operator is a DataFrame -> DataFrame function,
so the work is planned by Catalyst and runs on the executors.
"""

__version__ = "0.1.0"
