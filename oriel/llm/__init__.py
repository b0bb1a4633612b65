"""Training-data operators on Spark tables of documents, pages and labels.

Every operator is a function from DataFrame to DataFrame.  Nothing else in the
library imports this subpackage; ``queries`` registers one thin query for each.
"""
