"""Registered queries. Importing the modules fills the registry."""

from garimpo.plans import learning, preparation, reporting, spatial  # noqa: F401
from garimpo.plans.base import REGISTRY  # noqa: F401
