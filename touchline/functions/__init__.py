"""Column functions."""
from touchline.functions.scalars import *  # noqa: F403
