"""Registry of queries over the driver's tables, and their SQL."""

from . import q_events, q_jobs, q_people, q_scoring, q_store, q_text

QUERIES, ORACLES = {}, {}
for _part in (q_store, q_text, q_scoring, q_events, q_people, q_jobs):
    QUERIES |= _part.QUERIES
    ORACLES |= _part.ORACLES
