"""voxframe: the table work around training and judging speech-to-text models, on Spark.

Every operator takes DataFrames or Columns and returns DataFrames or Columns.
Results are computed when the caller runs an action; some plans need a figure first
(quantiles of an ordering column, a copy that is read several times).
"""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Python workers get the functions of this package with the task, so executors
# do not need it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
