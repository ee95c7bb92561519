"""quern: a Spark-native engine for stores of short memory records.

The package is organised by what a caller asks for:

* ``sources``    reading and writing the tables, JSONL logs and markdown notes
* ``functions``  column-level building blocks (text, numbers, metadata, vectors)
* ``operators``  DataFrame-to-DataFrame operators
* ``plans``      compositions of operators (recall, admission, lifecycle ...)
* ``streaming``  Structured Streaming forms of the stateful operators
"""

__version__ = "0.1.0"
