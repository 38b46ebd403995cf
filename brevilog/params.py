"""Every tunable constant of the engine in one place."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # The defaults below decide results and must not drift.
    short_bytes: int = 256          # texts below this size are never compacted
    sample_lines: int = 20          # lines looked at by the classifier
    confidence_floor: float = 0.55  # best score must reach this
    table_min_bytes: int = 8        # shorter lines do not count as table rows
    table_min_rows: int = 3
    column_bucket: int = 4          # byte columns per alignment bucket
    linear_min_lines: int = 4
    linear_base: float = 0.35
    linear_dup_weight: float = 0.65
    table_head: int = 3             # data rows kept after the header
    table_tail: int = 3
    table_max_distinct: int = 8     # distinct last-column values worth listing
    log_tail: int = 5               # raw lines kept at the end of a log
    tree_depth: int = 2             # deepest level kept
    context_lines: int = 10         # kept on each side of a failure line
    window_lines: int = 100         # live window
    window_min_lines: int = 20
    keep_logs: int = 100            # retention

    # Spark layout: lines per (run, block). No task ever has to hold more than
    # this many lines of one run, whatever the length of the run.
    block_lines: int = 65_536
    # Per-run facts are broadcast up to this many rows (a few dozen bytes each).
    broadcast_rows: int = 200_000


DEFAULTS = Params()
