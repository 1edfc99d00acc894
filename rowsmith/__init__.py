"""rowsmith: mapped, cleaned and validated bulk loads of spreadsheet-like data on Spark.

Every operator is a function ``DataFrame -> DataFrame`` (or a small family of
them) built from the DataFrame API, so Catalyst sees one declarative plan per
load.  Order-sensitive operators take the physical row number column ``_row``
as an explicit argument, because Spark frames carry no order.
"""

from rowsmith.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
