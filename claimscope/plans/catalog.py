"""Every registered query, with its DuckDB oracle where plain SQL can express it."""

from __future__ import annotations

from claimscope.plans import chain_q, claims_q, drift_q, eval_q, explain_q, governance_q, learn_q, ledger_q, live_q, purity_q, stream_q  # noqa: F401
