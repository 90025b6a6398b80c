"""Likeness: evaluate on Spark how well vectors identify the individual behind an item.

Every operator takes a DataFrame in the canonical layout and a list of *cell* columns
(``by``): the columns that tell independent evaluations apart (model, subset, repeat ...).
All cells move through one job together.

Canonical columns::

    item     key of the item            grp      source group; never split by group folds
    window   position inside the item   stratum  secondary category
    ind      individual (the label)     family   label of the individual
    v        ARRAY<DOUBLE>              kind     item set
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions of this package travel to the executors by value: nothing to install there.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
