"""The cluster's shared folder: intermediate tables and files that any executor may
read again after another one is lost."""

from __future__ import annotations

from larder.session import scratch_path as folder
from larder.session import stored

__all__ = ["folder", "stored"]
