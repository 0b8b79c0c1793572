"""Column -> Column expressions (JVM-side, whole-stage-codegen friendly)."""

from tessel.functions.text import *  # noqa: F401,F403
from tessel.functions.hashing import *  # noqa: F401,F403
