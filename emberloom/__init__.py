"""emberloom: a PySpark-native engine for small-corpus retrieval, topic and
survey analytics, with training-data operators in the llm subpackage."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
