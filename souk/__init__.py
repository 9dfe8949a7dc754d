"""souk: marketplace analytics on Spark.

Feature marts (orders, sellers, products), unit economics, seller ranking,
what-if curves, segments and distribution summaries, written as DataFrame
plans over a ``souk.sources.catalog.Marketplace``.
"""

__version__ = "0.1.0"
