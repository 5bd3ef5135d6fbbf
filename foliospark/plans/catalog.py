"""All registered queries of the library with their SQL."""
from __future__ import annotations

from foliospark.plans import admission_queries, claim_queries, extraction_queries, fact_queries, folder_queries, grid_queries, invariant_queries, ledger_queries, planner_queries, report_queries, search_queries, span_queries, state_queries, text_queries

_ALL = (search_queries, fact_queries, ledger_queries, text_queries, claim_queries, report_queries, state_queries, extraction_queries, planner_queries, span_queries, admission_queries, folder_queries, grid_queries, invariant_queries)


def plain(query):
    """Results in types that compare alike everywhere: dates as text, decimals as doubles."""

    def run(spark, sf_dir):
        df = query(spark, sf_dir)
        cast = {c: "string" if t == "date" else "double" for c, t in df.dtypes if t == "date" or t.startswith("decimal")}
        return df.withColumns({c: df[c].cast(t) for c, t in cast.items()}) if cast else df

    return run


QUERIES = {name: plain(query) for part in _ALL for name, query in part.QUERIES.items()}
ORACLES = {name: sql for part in _ALL for name, sql in part.ORACLES.items()}
FLAGSHIP = QUERIES["hybrid_rrf"]
