"""Public surface: every function takes and returns DataFrames."""

from sheaf.operators.entries import corpus_contents, decoded, derive_entries, files_only, read_contents  # noqa: F401
from sheaf.operators.metrics import (budget_breaches, event_gaps, last_n, latency_stats,  # noqa: F401
                                     metric_growth, running_progress)
from sheaf.operators.pack import budget_shares, model_fit, pack_next_fit  # noqa: F401
from sheaf.operators.prune import prune  # noqa: F401
from sheaf.operators.render import (document_stats, export, failed_summary, format_names, fragments,  # noqa: F401
                                    preorder, register_format, tree_lines)
from sheaf.operators.rolling import rolling_stats  # noqa: F401
from sheaf.operators.search import content_search, fuzzy_filter, match_count, match_positions  # noqa: F401
from sheaf.operators.select import (collect_selected, diff, expand, rollup, select_all,  # noqa: F401
                                    selected_flat, selection_states, selection_summary)
from sheaf.plans.chains import next_fit_sessions, throttle_reports  # noqa: F401
from sheaf.plans.history import replay  # noqa: F401
from sheaf.plans.ordered import ordered_scan  # noqa: F401
from sheaf.sources.policy import parse_policies, read_policies  # noqa: F401
from sheaf.sources.tree_listing import list_tree, read_tree  # noqa: F401
from sheaf.sources.tree_source import read_files  # noqa: F401
from sheaf.sources.tree_watch import watch  # noqa: F401
from sheaf.streaming.changes import (accepted, batch_summary, change_batches_stream, dirty_flags,  # noqa: F401
                                     read_change_stream, sessionize)
from sheaf.streaming.monitor import LateRows, LiveProgress, late_rows  # noqa: F401
from sheaf.streaming.stateful import (alert_timeline_stream, history_stream, incremental_tokens_stream,  # noqa: F401
                                      throttle_stream)

estimate = selection_summary
find = content_search
latency = latency_stats
pack = pack_next_fit
change_batches = sessionize
throttle = throttle_reports
