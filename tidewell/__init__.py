"""tidewell: batch analytics over open civic data, written as Spark DataFrame jobs.

Layout:
  functions/  pure Column rules (lenient casts, banding, labels, flags, geo)
  operators/  DataFrame -> DataFrame operators (rollups, top-k, sampling,
              refresh, data-quality, metric registry, statement audit, hex bins)
  sources/    table loading and landing readers (CSV/JSON feeds, nested shapes)
  plans/      the query registry over the shared test tables and the civic
              staging/mart definitions
  streaming/  file-triggered monthly refresh
"""

from tidewell.session import get_session, shared_dir

__all__ = ["get_session", "shared_dir"]
