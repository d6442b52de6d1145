"""Evidence-bound analytics as plain PySpark jobs.

Every public function takes DataFrames plus a small frozen config object and
returns a lazy DataFrame; Spark decides how the work is partitioned.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python functions that run in tasks travel inside the job, so executors need
# pandas and Arrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
