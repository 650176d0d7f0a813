from tardy.functions.columns import *  # noqa: F401,F403
from tardy.functions.columns import __all__  # noqa: F401
