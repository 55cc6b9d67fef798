"""The catalogue of queries: each operator applied to the test tables, with SQL that must agree."""
