"""reuselens: reuse-safety analytics for cached LLM answers, as Spark jobs.

Sub-packages
  functions/  column expressions (keys, constraint extraction, response audit, vectors)
  sources/    table loading, derived fixture views, idempotent sinks
  operators/  DataFrame operators (sampling, pairs, search, admission, metrics, costs, ledger)
  plans/      the registered queries and their DuckDB oracle SQL
  streaming/  Structured Streaming forms of admission, audit rates and the ledger
"""

__version__ = "0.1.0"
