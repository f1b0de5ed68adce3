"""The operators bound to the test tables, with their SQL twins."""

from . import model_queries, panel_queries, score_queries, text_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
