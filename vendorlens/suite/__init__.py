"""Registered queries, one per operator key (see ``vendorlens.registry``)."""
from vendorlens.suite import marts, models, reports, risk, scorecard  # noqa: F401
