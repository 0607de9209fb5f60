"""Query plans.

registry        queries over the shared test tables, one per operator family
oracle          the matching DuckDB statements (correctness gate)
civic_staging   the civic feeds' staging: raw text -> typed, cleaned frames
civic_marts     the civic marts, build info, metric table and warehouse build
civic_quality   the civic data checks, freshness rules and parse report
civic_queries   civic staging + marts on stand-in feeds laid out from the test tables
civic_build     warehouse build from a landing folder (CLI)
"""
