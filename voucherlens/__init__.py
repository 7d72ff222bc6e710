"""Specimen-record auditing and corpus preparation as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# functions of this package travel to the executors by value, so these need not have it installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])
