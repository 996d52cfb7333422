"""envlake: Spark-native processing for environmental sensor station lakes.

Sub-packages:
  functions  - column expressions (no UDFs): corrections, parsing, boundaries
  operators  - DataFrame -> DataFrame operators (sequence windows, batching, health, sync)
  sources    - lake readers/writers, file listing, replication, test-table adapters
  plans      - composed flows and the documented lake queries
  streaming  - Structured Streaming ingest, stateful correction, windowed aggregates
"""

__version__ = "0.1.0"
