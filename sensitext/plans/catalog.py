"""All registered queries. Importing the modules registers them."""

from . import log_queries, roundtrip_queries, stream_queries, text_queries  # noqa: F401
from .registered import ORACLES, QUERIES  # noqa: F401
