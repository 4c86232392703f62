"""Syntax checkers for the languages of the corpus: Python, JavaScript and Swift.

``parses(language, text, member)`` says whether a text is valid in a language.
"""

from __future__ import annotations

import sys

from . import javascript, python, swift

LANGUAGES = ("python", "javascript", "swift")
SUFFIX = {".py": "python", ".js": "javascript", ".swift": "swift"}

#: calls within one another that a text may need; beyond it counts as damaged
DEPTH = 1_000_000

_CHECK = {"python": python.parses, "javascript": javascript.parses, "swift": swift.parses}


def parses(language: str, text: str, member: bool = False, alone: bool = False) -> bool:
    """Whether ``text`` is valid ``language``.

    ``alone`` marks a definition cut out of its file (common indentation is
    removed first); ``member`` one that stood in a class body.
    """
    check = _CHECK[language]
    try:
        return check(text, member=member, alone=alone)
    except RecursionError:
        pass
    # a deep text is read once more with room for its depth; calls among Python functions take no room on the machine's stack
    usual = sys.getrecursionlimit()
    sys.setrecursionlimit(max(usual, DEPTH))
    try:
        return check(text, member=member, alone=alone)
    except RecursionError:
        return False
    finally:
        sys.setrecursionlimit(usual)
