"""Latency and packet-loss analytics on Spark."""

from hoplens.operators.extent import Extent, measure
from hoplens.operators.hosts import check_hosts, host_list, require_valid_targets, silent_targets
from hoplens.plans.ingest import ingest_runs, read_partials
from hoplens.plans.report import Report, analyse, analyse_file, analyse_runs, write_report
from hoplens.settings import Settings
from hoplens.sources.tables import read_samples
from hoplens.sources.text import scan_file, scan_partitioned, scan_runs

__all__ = [
    "Extent",
    "Report",
    "Settings",
    "analyse",
    "analyse_file",
    "analyse_runs",
    "check_hosts",
    "host_list",
    "ingest_runs",
    "measure",
    "read_partials",
    "read_samples",
    "require_valid_targets",
    "scan_file",
    "scan_partitioned",
    "scan_runs",
    "silent_targets",
    "write_report",
]
