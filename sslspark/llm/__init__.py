"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; ``__spark_entry__.py``
adds its queries only when it can be imported.
"""

import sys

from pyspark import cloudpickle

# what runs in tasks travels with them: executors need not have this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
