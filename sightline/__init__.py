"""sightline: multi-camera segmentation datasets as Spark tables.

Every public function takes DataFrames or Columns and returns DataFrames or
Columns.  Nothing keeps session state; jobs are started only by sinks, streaming
queries and the bounded key sample of :mod:`sightline.operators.ordered`.
"""
