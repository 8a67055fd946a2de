"""Text analytics on Spark: script conversion, segmentation, keyword ranking and lexicon handling as DataFrame operations."""

from pyspark import cloudpickle

# Functions sent to executors carry this package's code with them, so a cluster needs no installed copy of it.
cloudpickle.register_pickle_by_value(__import__(__name__))

__version__ = "0.1.0"

#: Grows when a signature of the public functions changes.
ABI = 1


def version_string() -> str:
    return __version__


def abi_number() -> int:
    return ABI
