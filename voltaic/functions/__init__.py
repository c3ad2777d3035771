"""Column-level functions (all built-in Spark expressions, codegen-friendly)."""

from voltaic.functions.columns import *  # noqa: F401,F403
from voltaic.functions.maps import *  # noqa: F401,F403
from voltaic.functions.calendar import *  # noqa: F401,F403
