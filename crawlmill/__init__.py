"""crawlmill: web-data analytics as Spark DataFrame operators.

Sub-packages
------------
functions   Column-in / Column-out expressions (text, html, urls, numbers, cron)
operators   DataFrame-in / DataFrame-out operators (prices, quality, pages, ...)
sources     table readers and sinks
plans       staged transforms plus the registered queries and their SQL oracles
streaming   Structured Streaming forms of the price, page-change and run monitors
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# the few Python helpers travel with their task, so executors need no copy of the package
register_pickle_by_value(sys.modules[__name__])
