"""contentwatch: Spark jobs that monitor published web content.

Every public function is a DataFrame -> DataFrame transform, a Column -> Column function, or a
reader or writer.  ``now`` is always a parameter.
"""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so a cluster needs no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
