"""Operations of a training-data pipeline: duplicates, quality, leaks, secrets, licences, tokens.

Nothing else in the library imports this subpackage.
"""

import panelkit
from pyspark import cloudpickle

# Functions travel to the executors whole; the library need not be installed there.
cloudpickle.register_pickle_by_value(panelkit)
