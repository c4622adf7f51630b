"""Code-archive analytics on Spark.

Every operator is a plain ``DataFrame -> DataFrame`` function that can be
chained with ``df.transform(...)``; one archive is one ``project_id`` and the
grain is one row per archive member.
"""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job, so the package
# need not be installed on the executors.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from ziplore.plans.corpus import analyze_corpus, analyze_files, analyze_project_dirs  # noqa: E402
from ziplore.session import configure  # noqa: E402

__all__ = ["analyze_corpus", "analyze_files", "analyze_project_dirs", "configure"]
