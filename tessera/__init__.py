"""tessera: retrieval-based text modelling and corpus analytics on Spark.

Every operator is a ``DataFrame -> DataFrame`` (or ``Column -> Column``)
function that composes with ``DataFrame.transform``; the heavy lifting is
left to Catalyst (joins, aggregates, windows) so plans scale with the
cluster.
"""

from tessera.session import get_spark, checkpoint_dir, load_table  # noqa: F401

__version__ = "0.1.0"
