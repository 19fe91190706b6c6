from .action_days import build_training_inputs_from_days, load_action_days, save_action_days
from .analytics import (
    action_type_frequency_by_position,
    action_types_by_position,
    sequence_length_distribution,
    sequence_lengths,
)
from .daily_metrics import (
    merged_action_types,
    merged_sequence_lengths,
    merged_summary,
    merged_types_by_position,
    metrics_by_day,
)
from .job import run_job
from .quality import action_type_distribution, calculate_dq_metrics, dq_metrics, dq_summary
from .training_inputs import build_training_inputs, history_entries, impression_activity

__all__ = [
    "action_type_distribution",
    "action_type_frequency_by_position",
    "action_types_by_position",
    "build_training_inputs",
    "build_training_inputs_from_days",
    "calculate_dq_metrics",
    "dq_metrics",
    "dq_summary",
    "history_entries",
    "impression_activity",
    "load_action_days",
    "merged_action_types",
    "merged_sequence_lengths",
    "merged_summary",
    "merged_types_by_position",
    "metrics_by_day",
    "run_job",
    "save_action_days",
    "sequence_length_distribution",
    "sequence_lengths",
]
