"""Import every catalogue module so that its queries register."""

from tessel.plans import catalog_core  # noqa: F401
from tessel.plans import catalog_balance  # noqa: F401
from tessel.plans import catalog_actors  # noqa: F401
from tessel.plans import catalog_similarity  # noqa: F401
from tessel.plans import catalog_cleaning  # noqa: F401
from tessel.plans import catalog_tei  # noqa: F401
from tessel.plans import catalog_experiments  # noqa: F401
from tessel.plans import catalog_models  # noqa: F401
from tessel.plans import catalog_sinks  # noqa: F401
