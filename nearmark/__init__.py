"""nearmark: top-N recommendation from implicit feedback, as Spark DataFrame jobs.

Layers:
  sources/    text and parquet scans, sinks, and the bindings to the test tables
  functions/  column expressions: vector maths, hash uniforms, safe arithmetic
  operators/  DataFrame -> DataFrame operators (prepare, similarity, scoring,
              evaluation, training)
  plans/      the three end-to-end jobs and the registered queries
"""

__version__ = "0.1.0"
