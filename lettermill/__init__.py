"""Spark jobs that classify, enrich, route and store job-application e-mail."""

import sys

from pyspark import cloudpickle

# Python workers need no installed copy: the few Python functions travel with the job.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
