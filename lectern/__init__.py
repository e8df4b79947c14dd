"""lectern: a Spark-native engine for turning landed web pages and notices
into a searchable chunk corpus and answering batches of questions over it.

Sub-packages:

* ``functions`` – column expressions (markup, links, text, dates, JSON);
* ``sources``   – landing tables, CSV/JSON/Parquet sinks and scans;
* ``operators`` – chunking, embedding, k-NN, retrieval, sessions,
                  backfill, summary;
* ``streaming`` – incremental ingestion with Structured Streaming;
* ``plans``     – the registered queries and their DuckDB oracles.
"""

__version__ = "0.1.0"
