"""Context analytics for conversation corpora on Spark.

Conversations, transcripts, captured requests and activity ledgers come in as DataFrames or
streams; profiles, findings, rewritten messages and savings go out as DataFrames.
"""

import sys

from pyspark import cloudpickle

# Executors receive the few Python functions by value and need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
