"""Dictionaries from elsewhere: a cache that is revalidated, and a worker's back-off. Driver only.

A transport is anything with `get(url, since)`; tests pass one that needs no network. Files are staged,
named by their URL's hash, and put in place by one rename; the cache's index is merged on each
write, so two processes can share it.
"""

from __future__ import annotations

import hashlib
import json
import os
import time
from dataclasses import asdict, dataclass, field
from pathlib import Path
from typing import Protocol

FRESH_SECONDS = 14 * 86400
RETRIES = (0.5, 1.0)
FIRST_WAIT, LONGEST_WAIT, IDLE_WAIT = 30, 3600, 6 * 3600


@dataclass
class Response:
    status: int
    body: bytes = b""
    last_modified: str | None = None


class Transport(Protocol):
    def get(self, url: str, since: str | None) -> Response: ...


class ResourceError(Exception):
    def __init__(self, message: str, permanent: bool = False):
        super().__init__(message)
        self.permanent = permanent


@dataclass
class Entry:
    path: str
    last_checked: float
    last_modified: str | None = None
    content_hash: str = ""


def network_off(environ: dict[str, str] | None = None, name: str = "QUILLSPARK_OFFLINE") -> bool:
    return (environ if environ is not None else os.environ).get(name, "").lower() not in ("", "0", "false")


class Cache:
    def __init__(self, folder: str | Path, transport: Transport | None, clock=time.time, sleep=time.sleep):
        self.folder, self.transport, self.clock, self.sleep = Path(folder), transport, clock, sleep
        self.folder.mkdir(parents=True, exist_ok=True)
        self.index: dict[str, Entry] = {}
        self.removed: set[str] = set()
        self.index = self._on_disk()

    def _on_disk(self) -> dict[str, Entry]:
        try:
            return {k: Entry(**v) for k, v in json.loads((self.folder / "index.json").read_text()).items()}
        except (OSError, ValueError, TypeError):
            return {}

    def _save(self) -> None:
        """Entries in memory win, those on disk fill gaps, removed ones go."""
        self.index = {k: v for k, v in {**self._on_disk(), **self.index}.items() if k not in self.removed}
        self._replace(self.folder / "index.json", json.dumps({k: asdict(v) for k, v in self.index.items()}).encode())
        self.removed.clear()

    @staticmethod
    def _replace(path: Path, data: bytes) -> None:
        part = path.with_name(f".{path.name}.{os.getpid()}.part")
        part.write_bytes(data)
        os.replace(part, path)

    def local(self, url: str) -> Path | None:
        """The cached file, if there is one; no network."""
        entry = self.index.get(url)
        return Path(entry.path) if entry and Path(entry.path).is_file() else None

    def _purge(self) -> None:
        for url in [u for u, e in self.index.items() if not Path(e.path).is_file()]:
            del self.index[url]
            self.removed.add(url)

    def _ask(self, url: str, since: str | None) -> Response:
        if self.transport is None or network_off():
            raise ResourceError("the network is off")
        try:
            return self.transport.get(url, since)
        except OSError as e:
            raise ResourceError(f"{url}: {e}") from e

    def fetch(self, url: str, force: bool = False) -> tuple[Path | None, bytes | None]:
        """(file in the cache, body of a changed or new one that is yet to be committed)."""
        self._purge()
        entry = self.index.get(url)
        if entry and not force and self.clock() - entry.last_checked < FRESH_SECONDS:
            return Path(entry.path), None
        answer = self._ask(url, None if entry is None or force else entry.last_modified)
        if entry:
            entry.last_checked = self.clock()
            same = answer.status == 304 or (answer.status == 200 and hashlib.sha256(answer.body).hexdigest() == entry.content_hash)
            if same or not 200 <= answer.status < 300:
                self._save()
                if not same:
                    raise ResourceError(f"{url}: status {answer.status}", 400 <= answer.status < 500)
                return Path(entry.path), None
        elif not 200 <= answer.status < 300:
            raise ResourceError(f"{url}: status {answer.status}", 400 <= answer.status < 500)
        self._modified = answer.last_modified
        return (Path(entry.path) if entry else None), answer.body

    def commit(self, url: str, body: bytes, last_modified: str | None = None) -> Path:
        """Put a body in place; the file of an earlier version goes if its name differs."""
        return self._commit_all({url: (body, last_modified)})[url]

    def _commit_all(self, bodies: dict[str, tuple[bytes, str | None]]) -> dict[str, Path]:
        """Put several bodies in place as one: all are written beside their places first, and one index names them all."""
        paths = {u: self.folder / f"{hashlib.sha256(u.encode()).hexdigest()}{Path(u).suffix}" for u in bodies}
        parts = {u: p.with_name(f".{p.name}.{os.getpid()}.part") for u, p in paths.items()}
        try:
            for url, (body, _) in bodies.items():
                parts[url].write_bytes(body)
        except OSError:
            for part in parts.values():
                part.unlink(missing_ok=True)
            raise
        for url, (body, last_modified) in bodies.items():
            old = self.index.get(url)
            os.replace(parts[url], paths[url])
            if old and old.path != str(paths[url]):
                Path(old.path).unlink(missing_ok=True)
            self.index[url] = Entry(str(paths[url]), self.clock(), last_modified, hashlib.sha256(body).hexdigest())
        self._save()
        return paths

    def get(self, url: str) -> Path:
        """The file, fetched if need be: a cold one is tried again twice, a cached one serves if that fails."""
        for wait in (*RETRIES, None):
            try:
                path, body = self.fetch(url)
                return path if body is None else self.commit(url, body, getattr(self, "_modified", None))
            except ResourceError as e:
                if cached := self.local(url):
                    return cached
                if e.permanent or wait is None or network_off() or self.transport is None:
                    raise
                self.sleep(wait)
        raise AssertionError

    def pair(self, first: str, second: str) -> str:
        """Two files that belong together: both are put in place or neither. -> fresh, new or refreshed"""
        had = self.local(first) and self.local(second)
        modified: dict[str, str | None] = {}

        def fetch(url: str, force: bool = False) -> tuple[Path | None, bytes | None]:
            answer = self.fetch(url, force)
            if answer[1] is not None:
                modified[url] = self._modified
            return answer

        got = [fetch(u) for u in (first, second)]
        changed = [body is not None for _, body in got]
        if any(changed) and not all(changed) and had:
            got = [g if c else fetch(u, force=True) for g, c, u in zip(got, changed, (first, second), strict=True)]
        if not any(changed):
            return "fresh"
        bodies = {u: body for u, (_, body) in zip((first, second), got, strict=True) if body is not None}
        self._commit_all({u: (body, modified[u]) for u, body in bodies.items()})
        return "refreshed" if had else "new"

    def clean(self) -> int:
        """Delete the cache's files, and only what lies in its folder by the cache's own names."""
        n = 0
        for entry in self.index.values():
            path = Path(entry.path)
            if path.parent == self.folder and len(path.stem) == 64:
                path.unlink(missing_ok=True)
                n += 1
        self.removed |= set(self.index)
        self.index = {}
        self._save()
        return n


@dataclass
class BackOff:
    """When an id may be tried again: doubling waits, never for permanent failures."""

    #: Failed attempts by id, and when the next may be; no time for one whose last failure is for good.
    attempts: dict[str, tuple[int, float | None]] = field(default_factory=dict)
    gone: set[str] = field(default_factory=set)

    def ready(self, name: str, now: float) -> bool:
        return name not in self.gone and (self.attempts.get(name, (0, now))[1] or 0.0) <= now

    def failed(self, name: str, now: float, permanent: bool = False) -> int:
        n = self.attempts.get(name, (0, None))[0]
        if permanent:
            self.gone.add(name)
            if n:
                self.attempts[name] = (n, None)
            return 0
        wait = min(FIRST_WAIT * 2 ** min(n, 7), LONGEST_WAIT)
        self.attempts[name] = (n + 1, now + wait)
        return wait

    def clear(self, name: str) -> None:
        self.attempts.pop(name, None)

    def kick(self) -> None:
        """Transient failures may be tried at once; permanent ones stay."""
        self.attempts.clear()

    def next_wait(self, now: float) -> float:
        return min((max(0.0, at - now) for _, at in self.attempts.values() if at is not None), default=IDLE_WAIT)


def keep_prefetching(names, ensure, back_off: BackOff, wait, arrived, clock=time.time) -> int:
    """Passes over what `names()` wants until `wait(seconds)` says to stop; the number of passes.

    `wait` returns True for a kick (all that failed for now is tried at once), False when its time is over,
    and None to stop. `arrived` is called after a pass that brought a dictionary that was not there.
    """
    passes = 0
    while True:
        if prefetch(names(), ensure, back_off, clock()):
            arrived()
        passes += 1
        kicked = wait(back_off.next_wait(clock()))
        if kicked is None:
            return passes
        if kicked:
            back_off.kick()


def prefetch(names: list[str], ensure, back_off: BackOff, now: float) -> bool:
    """One pass over wanted ids; whether a pair arrived that was not there (what calls for a recheck)."""
    new = False
    for name in names:
        if back_off.ready(name, now):
            try:
                new |= ensure(name) == "new"
                back_off.clear(name)
            except ResourceError as e:
                back_off.failed(name, now, e.permanent)
    return new
