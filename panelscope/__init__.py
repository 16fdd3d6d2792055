"""panelscope — labelled-sample dataset preparation and analysis on Spark.

Every operator is a plain function ``DataFrame -> DataFrame`` (or a lazy
one-row check frame) built from Spark SQL expressions; Arrow/pandas kernels
are used only where image bytes must be decoded or re-encoded.
"""

from panelscope.session import get_spark, ensure_checkpoint_dir

__all__ = ["get_spark", "ensure_checkpoint_dir"]
