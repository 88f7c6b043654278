"""Customer-retention and sales analytics as lazy Spark DataFrame jobs.

Layers, from the bottom up:

* ``functions``  column expressions and small statistical building blocks
* ``sources``    readers and partitioned writers
* ``operators``  one DataFrame-in / DataFrame-out function per analysis
* ``plans``      longer compositions of operators (feature table, churn run)
* ``streaming``  event-time KPIs on Structured Streaming
"""

__version__ = "0.1.0"
