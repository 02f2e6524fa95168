"""Repositories for tests, made with the git command."""

from __future__ import annotations

import os
import subprocess
from pathlib import Path


class Repo:
    def __init__(self, path: Path):
        self.path, self.clock = path, 1_700_000_000
        path.mkdir(parents=True)
        self.git("init", "-q", "-b", "main")

    def git(self, *args: str, **env: str) -> str:
        base = {"GIT_AUTHOR_NAME": "a", "GIT_AUTHOR_EMAIL": "a@x", "GIT_COMMITTER_NAME": "c", "GIT_COMMITTER_EMAIL": "c@x", "GIT_CONFIG_NOSYSTEM": "1", "HOME": str(self.path), "PATH": os.environ["PATH"]}
        return subprocess.run(["git", "-c", "core.autocrlf=false", "-c", "safe.directory=*", *args], cwd=self.path, env=base | env, check=True, capture_output=True, text=True).stdout

    def put(self, name: str, text: str) -> None:
        (self.path / name).parent.mkdir(parents=True, exist_ok=True)
        (self.path / name).write_bytes(text.encode())

    def commit(self, message: str, step: int = 60, **more: str) -> str:
        self.clock += step
        self.git("add", "-A")
        when = f"{self.clock} +0200"
        self.git("commit", "-q", "--allow-empty", "-m", message, GIT_AUTHOR_DATE=when, GIT_COMMITTER_DATE=when)
        return self.git("rev-parse", "HEAD").strip()
