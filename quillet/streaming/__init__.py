"""Streams of events and files."""

from .audit import *  # noqa: F403
from .files import *  # noqa: F403
