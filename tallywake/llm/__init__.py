"""Operations of a training-data pipeline.

Nothing outside this subpackage imports it, and it imports nothing of the rest
of the library, so the two folders ``llm/`` and ``tests/llm/`` can be removed.

Functions that run in Python workers travel by value, so executors need not
have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
