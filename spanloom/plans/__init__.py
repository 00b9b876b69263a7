"""Registered queries over the driver's tables, and the SQL that gives the same rows."""

from . import counter_plans, event_plans, file_plans, join_plans, line_plans, report_plans, screen_plans, sequence_plans, stream_plans, text_plans, trim_plans, window_plans

QUERIES: dict = {}
ORACLES: dict = {}
for _module in (counter_plans, event_plans, file_plans, join_plans, line_plans, report_plans, screen_plans, sequence_plans, stream_plans, text_plans, trim_plans, window_plans):
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
