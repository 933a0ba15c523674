"""Training-data operators. Nothing else in the library imports this package.

Functions of this package that run in Python workers are pickled by value, so
executors need numpy, pyarrow and the tokenizer files but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
