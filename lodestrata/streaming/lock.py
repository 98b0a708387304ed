"""One watcher per vault: a lock file that names the process holding it."""

from __future__ import annotations

import os


class WatchLock:
    """Held while the block runs; a lock whose process is gone is taken over. A second holder raises RuntimeError."""

    def __init__(self, path: str) -> None:
        self.path = path

    def _holder(self) -> int | None:
        try:
            with open(self.path) as f:
                pid = int(f.read().strip() or 0)
            os.kill(pid, 0)
        except PermissionError:
            return pid
        except (OSError, ValueError):
            return None
        return pid or None

    def __enter__(self) -> WatchLock:
        for _ in range(2):
            try:
                with os.fdopen(os.open(self.path, os.O_CREAT | os.O_EXCL | os.O_WRONLY), "w") as f:
                    f.write(str(os.getpid()))
                return self
            except FileExistsError:
                holder = self._holder()
                if holder:
                    raise RuntimeError(f"process {holder} already watches ({self.path})") from None
                os.unlink(self.path)
        raise RuntimeError(f"can't take {self.path}")

    def __exit__(self, *_: object) -> None:
        os.unlink(self.path)
