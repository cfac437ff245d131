"""costlens — cost observability on a lakehouse, built on Spark DataFrames.

Layout
------
sources/    table readers, schemas, fixture tables derived from the test data
functions/  column-level helpers (tag maps, display text, dates)
operators/  reusable relational building blocks (price join, latest version,
            run-timeline join, status-cost attribution, top-k, filters, metrics)
plans/      the user-facing results: cost views, dashboard reports, tag reports,
            materialisation and refresh
streaming/  intentionally empty: the source application has no streaming work
suite/      registered queries and their DuckDB oracle SQL
"""

__version__ = "0.1.0"
