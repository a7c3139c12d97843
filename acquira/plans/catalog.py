"""Every registered query: importing the modules of plans fills the registry."""

from acquira.plans import analytics, artefacts, audits, core, more, protocols, reports, selection, terms  # noqa: F401
from acquira.plans.registry import ORACLE, QUERIES  # noqa: F401
