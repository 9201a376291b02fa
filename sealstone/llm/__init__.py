"""Training-data pipeline operators (one module per operator).

Nothing outside this subpackage imports it; `queries.py` holds the thin
`opN_<name>` queries and `oracles.py` the DuckDB text for those that SQL can
express.
"""
