"""Document extraction analytics on Spark: text in, checked and scored records out."""

import sys

from pyspark import cloudpickle

from recordmill.session import build_session, configure, scratch_path

# functions run inside tasks travel by value, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "configure", "scratch_path"]
