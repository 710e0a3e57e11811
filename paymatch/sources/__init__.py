"""Sources: reference table schemas, loaders and test-table fixtures."""

from paymatch.sources.tables import (
    AuditSources,
    ProcessorBranch,
    conform,
    load_sources,
    read_processor_exports,
    read_table,
    reference_branches,
)

__all__ = [
    "AuditSources",
    "ProcessorBranch",
    "conform",
    "load_sources",
    "read_processor_exports",
    "read_table",
    "reference_branches",
]
