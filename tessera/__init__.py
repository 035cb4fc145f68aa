"""tessera: text-and-metrics analytics as Spark DataFrame plans.

Texts become vectors (TF-IDF, word-vector means, pooled model states),
vectors are scaled, reduced and clustered, clusters are scored and
summarised, similar texts are found, and a metric is regressed on another
per cluster with full influence diagnostics.  Every operator takes and
returns DataFrames; the only driver-side work is on small fitted
parameters (k cluster summaries, p regression coefficients, a handful of
scalars), each guarded by a size check.
"""

from tessera.session import local_session, shared_dir

__all__ = ["local_session", "shared_dir"]
