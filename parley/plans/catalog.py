"""Imports every job module so the registry is complete."""

from parley.plans import conversation_jobs, cost_jobs, file_jobs, join_jobs, judge_jobs, latency_jobs, match_jobs, redact_jobs, rule_jobs, retrieval_jobs, score_jobs, stream_jobs, udf_jobs  # noqa: F401
from parley.plans.registry import JOBS, ORACLE

__all__ = ["JOBS", "ORACLE"]
