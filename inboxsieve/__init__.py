"""inboxsieve: Spark-native email-intent triage.

Main entry points::

    from inboxsieve.plans.triage import triage_batch, categorize_table
    from inboxsieve.streaming.triage_stream import triage_stream
    from inboxsieve.operators import sanitize, contract, dedupe, evaluate

See README.md for the operator inventory and the scale design.
"""

__version__ = "0.1.0"
