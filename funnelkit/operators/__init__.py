"""DataFrame -> DataFrame operators."""

from funnelkit.operators.asof import asof_latest
from funnelkit.operators.enrich import (
    Lookup, Step, enrich_chain, enrich_colocated, enrich_group, enrich_left, flag_member, key_violations,
)
from funnelkit.operators.filters import lookback, report_window, stage_prefilter, window_condition
from funnelkit.operators.incremental import (
    advance_snapshot, asof_from_snapshot, distinct_state, event_snapshot, finish_signals, merge_states, read_days, signal_state, write_days,
)
from funnelkit.operators.latest import distinct_keys, latest_non_null, latest_value, signal_rollup
from funnelkit.operators.stitch import prefixed, stitch, stitch_branches, stitch_split
from funnelkit.operators.waterfall import waterfall

__all__ = [
    "asof_latest", "Lookup", "Step", "enrich_group", "enrich_colocated", "enrich_chain", "enrich_left", "flag_member", "key_violations",
    "lookback", "report_window", "stage_prefilter", "window_condition",
    "distinct_keys", "latest_non_null", "latest_value", "signal_rollup",
    "event_snapshot", "advance_snapshot", "asof_from_snapshot", "signal_state", "merge_states", "finish_signals", "distinct_state",
    "write_days", "read_days",
    "prefixed", "stitch", "stitch_branches", "stitch_split", "waterfall",
]
