"""Applying a job to the tables: read once, decide once, write everything.

A job built with ``store=True`` has its decisions (every call with its code, ids and
balances) in the shared folder, so the new table, the facts and the audit rows are all
derived from one table of decisions and nothing is decided twice. Each output goes to a
folder of its own version (``version=...``, ``batch=...``) and is overwritten as a whole,
so running the step again after a crash gives the same tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources import tables
from .audit import numbered_audit


def apply_job(job, root: str, entity: str, version: str, audit_log: DataFrame, every: str = "day") -> None:
    """Write the job's new ``entity`` table (``inventory`` or ``task``), its audit rows
    and, if it has any, its consumption facts below ``root`` (a folder for each ``every``)."""
    tables.write_snapshot(job.table, root, entity, version)
    if hasattr(job, "facts"):
        tables.append_facts(job.facts, root, "consumption", batch=version, every=every)
    tables.append_facts(numbered_audit(audit_log, job.audit), root, "audit_log", batch=version, every=every)
