"""A causal analytics engine whose data work is ordinary Spark DataFrame plans."""

import os

# driver and worker algebra is p x p: threads of a BLAS would only contend with Spark's tasks
for _name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"):
    os.environ.setdefault(_name, "1")

__version__ = "0.1.0"
