"""Spark-native analytics of coded event data."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from stanzagraph.operators.accumulate import Accumulation, accumulate  # noqa: E402
from stanzagraph.operators.model import Model, ena, fit  # noqa: E402
from stanzagraph.spec import AccumulateSpec, Edge  # noqa: E402

__all__ = ["AccumulateSpec", "Accumulation", "Edge", "Model", "accumulate", "ena", "fit"]
