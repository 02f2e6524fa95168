"""Typed errors of readers in FAILFAST mode; in PERMISSIVE mode their codes stand in an `error` column."""

from __future__ import annotations

MODES = ("FAILFAST", "PERMISSIVE")


class RepoError(Exception):
    """Base of all; `code` is the class's name."""

    @property
    def code(self) -> str:
        return type(self).__name__


class NotAGitRepo(RepoError): ...


class CorruptedObject(RepoError): ...


class MalformedObject(RepoError): ...


class MalformedRef(RepoError): ...


class SymrefTooDeep(RepoError): ...


class LimitExceeded(RepoError): ...


class NotFound(RepoError): ...


class InvalidPath(RepoError): ...


class PathTooLong(RepoError): ...


class PathTraversal(RepoError): ...


class AbsolutePath(RepoError): ...


def raising(code: str, what: str = "") -> RepoError:
    """The error of a code."""
    return {c.__name__: c for c in RepoError.__subclasses__()}[code](what)
