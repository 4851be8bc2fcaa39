"""Results of searches kept for a while: in memory, and in a file that outlives the driver."""

from __future__ import annotations

import hashlib
import json
import sqlite3
import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Sequence
from pathlib import Path
from typing import Any


def cache_key(query: str, limit: int, vaults: Sequence[str] | None, alpha: float, beta: float, when: Any = None, version: Any = 0) -> str:
    """SHA-256 of everything a result depends on, the version of the tables included; weights at full precision."""
    return hashlib.sha256(json.dumps([query, limit, sorted(vaults or []), float(alpha), float(beta), when, version], ensure_ascii=False, default=str).encode()).hexdigest()


def _text(value: Any) -> str | None:
    try:
        return json.dumps(value, ensure_ascii=False)
    except (TypeError, ValueError):
        return None


class QueryCache:
    """JSON values by key for ``ttl`` seconds; when full, what was used longest ago goes. Safe for threads."""

    def __init__(self, ttl: float = 3600, entries: int = 1000, clock: Callable[[], float] = time.time):
        self.ttl, self.entries, self.clock = ttl, entries, clock
        self._lock = threading.Lock()
        self._held: OrderedDict[str, list] = OrderedDict()  # key: [text, created, hits]

    def get(self, key: str) -> Any | None:
        with self._lock:
            found = self._held.get(key)
            if not found:
                return None
            if self.clock() - found[1] > self.ttl:
                del self._held[key]
                return None
            found[2] += 1
            self._held.move_to_end(key)
            return json.loads(found[0])

    def set(self, key: str, value: Any) -> bool:
        """Whether the value could be kept: it must be JSON."""
        text = _text(value)
        if text is None:
            return False
        with self._lock:
            self._held.pop(key, None)
            while len(self._held) >= self.entries:
                self._held.popitem(last=False)
            self._held[key] = [text, self.clock(), 1]
        return True

    def delete(self, key: str) -> bool:
        with self._lock:
            return self._held.pop(key, None) is not None

    def clear(self) -> int:
        with self._lock:
            n = len(self._held)
            self._held.clear()
            return n

    def cleanup(self) -> int:
        """Drop what is too old; how many that was."""
        with self._lock:
            old = [k for k, v in self._held.items() if self.clock() - v[1] > self.ttl]
            for k in old:
                del self._held[k]
            return len(old)


class FileCache:
    """The same in a SQLite file on the driver, so it outlives the process. A value that is no JSON any more is dropped."""

    def __init__(self, path: str, ttl: float = 3600, entries: int = 1000, clock: Callable[[], float] = time.time):
        self.ttl, self.entries, self.clock = ttl, entries, clock
        self._lock = threading.Lock()
        file = Path(path).expanduser()
        file.parent.mkdir(parents=True, exist_ok=True)
        self._db = sqlite3.connect(file, check_same_thread=False, isolation_level=None)
        self._db.execute("CREATE TABLE IF NOT EXISTS results (key TEXT PRIMARY KEY, value TEXT, created REAL, used REAL, hits INTEGER)")

    def get(self, key: str) -> Any | None:
        with self._lock:
            row = self._db.execute("SELECT value, created FROM results WHERE key = ?", (key,)).fetchone()
            if row is None:
                return None
            try:
                value = json.loads(row[0]) if self.clock() - row[1] <= self.ttl else None
            except ValueError:
                value = None
            if value is None:
                self._db.execute("DELETE FROM results WHERE key = ?", (key,))
            else:
                self._db.execute("UPDATE results SET used = ?, hits = hits + 1 WHERE key = ?", (self.clock(), key))
            return value

    def set(self, key: str, value: Any) -> bool:
        text = _text(value)
        if text is None:
            return False
        with self._lock:
            self._db.execute("DELETE FROM results WHERE key = ?", (key,))
            over = self._db.execute("SELECT count(*) FROM results").fetchone()[0] - self.entries + 1
            if over > 0:
                self._db.execute("DELETE FROM results WHERE key IN (SELECT key FROM results ORDER BY used, key LIMIT ?)", (over,))
            now = self.clock()
            self._db.execute("INSERT INTO results VALUES (?, ?, ?, ?, 1)", (key, text, now, now))
        return True

    def delete(self, key: str) -> bool:
        with self._lock:
            return self._db.execute("DELETE FROM results WHERE key = ?", (key,)).rowcount > 0

    def clear(self) -> int:
        with self._lock:
            return self._db.execute("DELETE FROM results").rowcount

    def cleanup(self) -> int:
        with self._lock:
            return self._db.execute("DELETE FROM results WHERE ? - created > ?", (self.clock(), self.ttl)).rowcount

    def close(self) -> None:
        self._db.close()


class TwoLevelCache:
    """The file first, as it knows what other processes found, then memory; both are written."""

    def __init__(self, memory: QueryCache, file: FileCache | None = None):
        self.levels = [x for x in (file, memory) if x is not None]

    def get(self, key: str) -> Any | None:
        return next((value for level in self.levels if (value := level.get(key)) is not None), None)

    def set(self, key: str, value: Any) -> bool:
        return all([level.set(key, value) for level in self.levels])

    def clear(self) -> int:
        return max(level.clear() for level in self.levels)
