"""Column expressions: everything here stays in the JVM."""

from .cells import *  # noqa: F403
from .codes import *  # noqa: F403
from .dates import *  # noqa: F403
from .text import *  # noqa: F403
