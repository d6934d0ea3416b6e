"""Temporal graph analytics on Spark. The names of ``__all__`` are stable; they are loaded
when they are first used, so that workers import only what they run."""

from importlib import import_module

__version__ = "0.2.0"
_HOME = {
    "Session": "plans.session",
    "load_edges": "plans.session",
    "load_dataset": "plans.datasets",
    "snapshot_dataset": "plans.datasets",
    "SnapshotDataset": "plans.datasets",
    "Task": "plans.tasks",
    "task": "plans.tasks",
    "register_task": "plans.tasks",
    "model": "plans.tasks",
    "events": "operators",
    "messages": "operators",
    "partitioning": "operators",
    "sampling": "operators",
    "snapshots": "operators",
    "state": "operators",
    "temporal": "operators",
    "metrics": "functions",
    "artifacts": "sources",
    "edges": "sources",
}
__all__ = ["__version__", *_HOME]


def __getattr__(name: str):
    if name not in _HOME:
        raise AttributeError(f"chronoloom has no {name}")
    home = import_module(f"chronoloom.{_HOME[name]}")
    return getattr(home, name) if "." in _HOME[name] else import_module(f"chronoloom.{_HOME[name]}.{name}")
