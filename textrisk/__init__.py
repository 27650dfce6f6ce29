"""Find, redact and score personal data in large tables of text with Spark."""

from textrisk.plans.analyze import analyze, assess
from textrisk.plans.audit import audit, run_audit
from textrisk.plans.ingest import ingest, ingest_mastodon, ingest_reddit
from textrisk.plans.model import RiskModel
from textrisk.plans.train import train
from textrisk.sources.records import read_records, write_records

__all__ = [
    "RiskModel",
    "analyze",
    "assess",
    "audit",
    "ingest",
    "ingest_mastodon",
    "ingest_reddit",
    "read_records",
    "run_audit",
    "train",
    "write_records",
]
