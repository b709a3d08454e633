"""Every registered market query that has SQL against DuckDB on the smallest tables."""

import duckdb
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def _rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    near = lambda v: (v is None, round(v, 6) + 0.0 if isinstance(v, float) else v)
    return sorted((tuple(near(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, con, name):
    got = registry.queries()[name](spark, SF)
    rel = con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(rel.columns)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(rel.columns, rel.fetchall())


#: Queries without SQL: columns that must not be null, and the least number of rows over the smallest tables.
EXPECTED = {
    "state_columns": ("close", 4000), "state_signals": ("time", 4000), "strategy_significance": ("n", 10), "zigzag": ("price", 3), "renko": ("close", 1), "point_figure": ("boxes", 1),
    "state_strategies": ("time", 4000), "strategy_backtests": ("net", 70), "headline_slug": ("page_id", 50), "page_text": ("n_chars", 50), "sentence_counts": ("n_sentences", 200),
    "novelty_cosine": ("doc_id", 200), "headline_dedupe": ("leader", 50), "option_greeks": ("strike", 8), "chart_patterns": ("status", 0), "chart_signals": ("time", 0),
    "guidance_direction": ("guidance", 200), "call_text_metrics": ("n_words", 200), "risk_parity_weights": ("weight", 4000), "wyckoff_phase": ("time", 4000), "pair_positions": ("weight_a", 763), "hawkes_panel": ("n_mean", 30),
}


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracle_sql())))
def test_rows_without_sql(spark, name):
    column, least = EXPECTED[name]
    rows = registry.queries()[name](spark, SF).collect()
    assert len(rows) >= least and all(r[column] is not None for r in rows)
