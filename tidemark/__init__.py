"""tidemark: streaming ingest whose guarantees can be checked, on PySpark."""

from tidemark.errors import Refused

__all__ = ["Refused"]
