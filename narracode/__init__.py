"""narracode: multi-label coding of long text records on Spark DataFrames."""

__version__ = "0.1.0"
