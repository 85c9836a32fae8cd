"""Governed data work as Spark plans: redaction, policy, join discovery,
entity resolution, metric catalog, audit analytics and landed-data ingest."""

import sys

from pyspark import cloudpickle

# The few Arrow functions travel with the job, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
