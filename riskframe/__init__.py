"""riskframe: a PySpark-native engine for group health-insurance underwriting data.

Every operator is a function from DataFrame(s) to a DataFrame built from Spark's
own expressions (or a Structured Streaming job).  Sub-packages:

* ``functions`` - column expressions, fixed lookup values, distributed statistics
* ``sources``   - table scans, fixtures derived from the test tables, sinks
* ``operators`` - the operator catalogue (ingest, harmonise, rollup, ...)
* ``plans``     - composed end-to-end jobs and the query registry
* ``streaming`` - Structured Streaming ingest jobs
"""

__version__ = "0.1.0"
