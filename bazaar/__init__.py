"""bazaar — e-commerce warehouse analytics as Spark DataFrame jobs.

Layers (staging -> core -> analytics) are DataFrames; every transformation is
declared with the DataFrame API so that Catalyst and AQE choose the physical
plan.  Sub-packages:

* ``sources``   — readers for the nine staging tables (CSV / Parquet / the
                  driver's TPC-H-like tables mapped onto the staging schema)
* ``functions`` — Column-level helpers (exact rounding, month arithmetic,
                  RFM segment rules)
* ``operators`` — reusable DataFrame -> DataFrame operators (quality checks,
                  distributed global ordering, latest-per-key, shares, cohorts)
* ``plans``     — the query catalogue: staging checks, star-schema builds,
                  metrics, cohorts, RFM/LTV, tests, and the full warehouse build
* ``streaming`` — intentionally empty (the source workload is batch only)
"""

__version__ = "0.1.0"
