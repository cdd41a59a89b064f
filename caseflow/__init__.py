"""caseflow: process analytics on Spark.

Cases (bills) move through steps (actions); the library derives outcome
features, step transitions with dwell times, cross-tabs, latest states,
top-k time series and statistics, tabular classification and text-corpus
preparation, all as DataFrame-to-DataFrame functions on Spark SQL / MLlib.
"""

__version__ = "0.1.0"
