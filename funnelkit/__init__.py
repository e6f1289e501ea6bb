"""funnelkit: record-level funnel tables on Spark.

Every operator takes and returns a DataFrame (``funnelkit.operators``) or builds a
Column expression (``funnelkit.functions``). Rule sets and the composed mart live in
``funnelkit.plans``; table readers and the fixture role adapters in
``funnelkit.sources``.
"""

from funnelkit.session import build_session

__all__ = ["build_session"]
