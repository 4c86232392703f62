"""Validity of Python text under the grammar of the running interpreter.

``symtable`` runs the C parser without building Python objects, which is about
half the price of ``ast.parse``; what it rejects is tried again with
``ast.parse``, since it also reports errors that are not of the grammar.
"""

from __future__ import annotations

import ast
import symtable
import textwrap
import warnings

_ERRORS = (SyntaxError, ValueError, MemoryError, OverflowError)


def parses(text: str, member: bool = False, alone: bool = False) -> bool:
    """Whether ``text`` parses; with ``alone`` its common indentation is removed first.

    What the interpreter calls too complex (over 200 brackets in one another) doesn't.
    """
    if alone and text[:1] in " \t\n\r":
        text = textwrap.dedent(text)
    try:
        symtable.symtable(text, "<source>", "exec")
        return True
    except RecursionError:  # parsed; only what is made of it is too deep
        return True
    except _ERRORS:
        pass
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            ast.parse(text)
        return True
    except RecursionError:
        return True
    except _ERRORS:
        return False
