"""No streaming operators: every source of this domain is bounded.

Fitted stages (:class:`~lumiframe.operators.scale.PopulationScalerModel`,
:class:`~lumiframe.operators.pls.PLSModel`, stored pipelines) are plain
``transform`` calls without aggregation, so nothing further is needed here.
"""
