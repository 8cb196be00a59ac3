"""Storeflow: online-store analytics as Spark DataFrame operators.

Sub-packages:
  sources    table loading, catalog generation, JSON decode/encode, synthetic traffic
  functions  column-expression builders (scalar rules, validation, hashing)
  operators  DataFrame -> DataFrame operators (search, keyed ops, orders, stats, queues)
  plans      the registered query plans over the driver tables, with oracle SQL
  streaming  Structured Streaming order pipeline
"""

__all__ = ["session"]
