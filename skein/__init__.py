"""skein: developer-activity and code-context analytics on PySpark.

Every operator takes DataFrames and keyword parameters and returns a lazy DataFrame.  ``skein.llm``
holds the training-data operators; nothing else in the package imports it.
"""

__version__ = "0.1.0"
