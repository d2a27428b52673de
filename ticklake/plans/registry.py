"""All registered queries of the market operators and their SQL oracles."""

from __future__ import annotations

from ticklake.operators.book import DEPTH_COLUMNS
from ticklake.plans import analytics, archives, books, bridge, fills, model, scalars, tape  # noqa: F401  (each registers its queries)

#: Columns that DuckDB sums to wider numbers or writes as decimals, with the type that they have here.
TYPES = {
    "b08_depth": "bigint " + " ".join(c for c in DEPTH_COLUMNS if c.endswith(("_size", "c"))),
    "b03_level_state": "bigint qty",
    "b05_bbo": "bigint bid_size ask_size",
    "b06_valid_bbo": "bigint bid_size ask_size",
    "b10_lob_history": "bigint qty",
    "b12_boundary_drift": "bigint rebuilt",
    "b13_drift_metric": "bigint drift",
    "b15_cross_midnight_seed": "bigint bid_size ask_size",
    "b15_built_date": "bigint bid_size ask_size",
    "b16_restarted_books": "bigint bid_size ask_size",
    "k09_bbo_view": "bigint bid_1_size ask_1_size",
    "st07_latest_book": "bigint bid_size ask_size",
    "a16_round_trip_pnl": "bigint pnl fees",
    "o04_best_and_worst": "bigint pnl",
    "x11_settlement_pnl": "bigint pnl",
    "a34_settlement_bounds": "bigint best worst",
    "a15_positions": "bigint position",
    "w11_pnl_curve": "bigint total peak drawdown",
    "w12_gross_exposure": "bigint most",
    "w15_position_cap": "bigint paid",
    "w18_attribution": "bigint cash",
    "j17_reconciliation": "bigint internal actual",
    "b18_queue_fills": "bigint filled",
    "s10_candles": "bigint volume",
    "a02_daily": "bigint volume",
    "a03_per_market": "bigint volume",
    "a04_per_series": "bigint volume",
    "a06_hourly": "bigint volume",
    "a09_liquidity": "bigint volume",
    "a10_rollups": "bigint volume",
    "w02_sequence_gaps": "bigint missing",
    "w07_cumulative": "bigint total",
    "o06_best_parameter": "bigint score",
    "o07_sweep_matrix": "bigint hi_60 hi_70",
    "d08_tape_summary": "bigint n_duplicate",
    "u02_duplicates": "bigint n n_duplicate",
    "a21_threshold_pnl": "double threshold",
    "j22_parameter_sweep": "double threshold",
    "p17_clock_seconds": "double seconds",
    "p06_flat_snapshots": "double yes_depth no_depth",
    "p05_p08_flat_frames": "double amount",
    "s01_k02_archive": "double amount",
    "s02_k05_merged": "double amount",
    "k06_d04_compaction": "bigint volume",
    "k07_materialized_trades": "double size",
    "k10_history_sink": "bigint qty",
}


def _typed(name: str, sql: str) -> str:
    if name not in TYPES:
        return sql
    kind, *columns = TYPES[name].split()
    casts = ", ".join(f"cast({c} as {kind}) as {c}" for c in columns)
    return f"select * replace ({casts}) from ({sql}) typed"


QUERIES = bridge.QUERIES
ORACLES = {name: _typed(name, sql) for name, sql in bridge.ORACLES.items()}
