"""Registered queries, each with its SQL where SQL can express it."""

from . import check_queries, config_queries, file_queries, pickle_queries, scan_queries, score_queries, source_queries, statistics_queries, text_queries, verdict_queries

MODULES = (text_queries, check_queries, statistics_queries, file_queries, config_queries, score_queries, verdict_queries, pickle_queries, scan_queries, source_queries)
