"""starweave: process-mining event logs from star schemas, as Spark DataFrame jobs.

    from starweave import ImportSpec, load_sources, event_log, case_table, finance

    spec = ImportSpec.from_config(config_json)
    sources = load_sources(spark, spec)
    log = event_log(spec, sources)
"""

from .operators.audit import cases_without_events, fk_orphans, pk_duplicates, profile_columns
from .operators.measures import durations, event_order, summarize
from .operators.star import star_join
from .plans.eventlog import (
    case_aggregate, case_table, case_values_on_events, event_log, finance, group_aggregate, summary,
)
from .plans.spec import Attribute, Dataset, ImportSpec, JoinEdge, Roles, SpecError
from .sources.readers import load_sources, read_dataset
from .sources.sinks import write_log

__all__ = [
    "Attribute", "Dataset", "ImportSpec", "JoinEdge", "Roles", "SpecError",
    "load_sources", "read_dataset", "write_log",
    "star_join", "event_log", "case_table", "case_aggregate", "group_aggregate", "finance",
    "case_values_on_events",
    "fk_orphans", "pk_duplicates", "cases_without_events", "profile_columns",
    "durations", "event_order", "summarize", "summary",
]
