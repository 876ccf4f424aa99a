"""Lectern: learning-platform analytics as plain Spark jobs.

Layers, from raw logs to reports:

* ``sources``   raw JSON / TSV logs, warehouse scans, stream sources
* ``functions`` scalar column expressions
* ``operators`` reusable DataFrame -> DataFrame operators
* ``plans``     the batch jobs (cleaning, wide tables, reports)
* ``streaming`` the streaming jobs
* ``sinks``     partition overwrite, versioned result tables, upserts
"""

__version__ = "0.1.0"
