"""Fetching a dataset's file to a path."""

from __future__ import annotations

import os
import shutil
import time
import urllib.error
import urllib.request
from collections.abc import Callable
from pathlib import Path


def passing(error: Exception) -> bool:
    """Whether another try may help: servers' own errors, lost connections, names that don't resolve and timeouts; not a client's mistakes."""
    if isinstance(error, urllib.error.HTTPError):
        return error.code >= 500
    return isinstance(error, (urllib.error.URLError, TimeoutError, OSError))


def fetch(url: str, path: str | Path, tries: int = 4, pause: float = 1.0, timeout: float = 60.0, opener: Callable = urllib.request.urlopen) -> Path:
    """Fetch url to path, which appears only once it is whole; pauses double between tries."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    part = path.with_name(path.name + ".part")
    for n in range(tries):
        try:
            with opener(url, timeout=timeout) as source, part.open("wb") as target:
                shutil.copyfileobj(source, target)
            os.replace(part, path)
            return path
        except Exception as error:
            part.unlink(missing_ok=True)
            if n + 1 == tries or not passing(error):
                raise
            time.sleep(pause * 2**n)
    raise ValueError("at least one try")
