"""Reading of raw logs and of stored cycles, and building of cycles with RUL."""

from wearline.sources.builder import *  # noqa: F403
from wearline.sources.catalog import *  # noqa: F403
from wearline.sources.readers import *  # noqa: F403
