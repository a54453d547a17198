"""sitelens: site-index analytics as Spark jobs.

Tables of sites and captured web responses go in; discovered URLs,
extracted page metadata, canonical pages, per-site scores and one
``llms.txt`` document per site come out, together with an audit trail of
runs, stages and events.  Every stage is a DataFrame plan keyed by
``run_id`` / ``site`` so that all sites are processed in one job.
"""

from sitelens.session import build_session, prepare_session

__all__ = ["build_session", "prepare_session"]
