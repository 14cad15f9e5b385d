"""Named queries, each paired with the SQL it is checked against."""

from importlib import import_module

from .catalogue import ENTRIES, Entry

_MODULES = (
    "evaluation", "job_queries", "attempt_queries", "text_queries", "code_queries", "graph_queries", "proposal_queries",
    "seam_queries", "plan_queries",
)


def all_entries() -> dict[str, Entry]:
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
    return dict(ENTRIES)
