"""Working copies of repositories, by the git program on the driver."""

from __future__ import annotations

import shutil
import subprocess
from pathlib import Path
from urllib.parse import urlsplit, urlunsplit


def _git(*arguments: str, where: str | None = None) -> str:
    done = subprocess.run(["git", *(["-C", where] if where else []), *arguments], capture_output=True, text=True)
    if done.returncode:
        raise RuntimeError(f"git {arguments[0]} ended with {done.returncode}: {done.stderr.strip()}")
    return done.stdout.strip()


def place_of(folder: str, repo: str, commit: str) -> Path:
    """Where a repository (owner/name) is put at a commit."""
    return Path(folder) / f"{repo.replace('/', '_')}_{commit[:8]}"


def with_token(url: str, token: str | None) -> str:
    """An https address with a token for its host; other addresses stay as they are."""
    parts = urlsplit(url)
    if not token or parts.scheme != "https" or "@" in parts.netloc:
        return url
    return urlunsplit(parts._replace(netloc=f"oauth2:{token}@{parts.netloc}"))


def without_token(text: str) -> str:
    """A text, such as an error, with the user part of its addresses blanked out."""
    import re

    return re.sub(r"(\w+://)[^\s/@]+@", r"\1***@", text)


def clone(url: str, target: str, branch: str | None = None, token: str | None = None) -> str:
    """Clones an address into a folder that isn't there yet and returns the head's name; a failed clone leaves nothing."""
    if Path(target).exists():
        raise FileExistsError(target)
    try:
        _git("clone", "-q", *(["--branch", branch] if branch else []), with_token(url, token), target)
        return _git("rev-parse", "HEAD", where=target)
    except RuntimeError as error:
        shutil.rmtree(target, ignore_errors=True)
        raise RuntimeError(without_token(str(error))) from None


def at_commit(url: str, folder: str, repo: str, commit: str) -> str:
    """A working copy of a repository at a commit; one that is there already is only checked out, a failed one is removed."""
    place = place_of(folder, repo, commit)
    fresh = not (place / ".git").exists()
    try:
        if fresh:
            place.parent.mkdir(parents=True, exist_ok=True)
            _git("clone", "-q", "--no-checkout", url, str(place))
        if fresh or not _git("rev-parse", "HEAD", where=str(place)).startswith(commit):
            _git("checkout", "-q", "--force", commit, where=str(place))
        return str(place)
    except RuntimeError:
        if fresh:
            shutil.rmtree(place, ignore_errors=True)
        raise


def head(place: str) -> dict[str, str | None]:
    """Name of the head and address of the remote of a working copy; the address is None without one."""
    try:
        remote = without_token(_git("remote", "get-url", "origin", where=place)) or None
    except RuntimeError:
        remote = None
    return {"head_sha": _git("rev-parse", "HEAD", where=place), "remote": remote}
