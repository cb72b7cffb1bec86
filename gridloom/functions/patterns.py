"""Search patterns: checked on the driver, then written in the dialect of Spark's regular expressions (Java)."""
from __future__ import annotations

import re

import regex

from .cells import TableError

LONGEST_PATTERN = 500


def literal(text: str, ignore_case: bool = False) -> str:
    """A pattern that matches `text` itself."""
    return ("(?iu)" if ignore_case else "") + r"\Q" + text.replace(r"\E", r"\E\\E\Q") + r"\E"


def pattern(text: str, ignore_case: bool = False) -> str:
    """A user's regular expression: not empty, not too long, valid; named groups and \\Z respelled."""
    if not text:
        raise TableError("the pattern is empty")
    if len(text) > LONGEST_PATTERN:
        raise TableError(f"the pattern is longer than {LONGEST_PATTERN} characters")
    try:
        regex.compile(text)
    except regex.error as error:
        raise TableError(f"the pattern is not valid: {error}") from None
    java = re.sub(r"\(\?P<(\w+)>", r"(?<\1>", text)
    java = re.sub(r"\(\?P=(\w+)\)", r"\\k<\1>", java)
    java = re.sub(r"(?<!\\)((?:\\\\)*)\\Z", r"\1\\z", java)
    return ("(?iu)" if ignore_case else "") + java


def whole(java_pattern: str) -> str:
    """Anchor a pattern to the whole text."""
    return rf"^(?:{java_pattern})\z"


def literal_replacement(text: str) -> str:
    return text.replace("\\", "\\\\").replace("$", r"\$")


_TEMPLATE = re.compile(r"\\g<(\d+)>|\\g<(\w+)>|\\(\d{1,2})|\\([ntr\\])|(\$)")
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "\\": r"\\"}


def replacement(template: str) -> str:
    """A replacement with \\1, \\g<1> or \\g<name>, respelled with $. A digit after a group is kept apart from it."""
    def respell(match):
        number = match.group(1) or match.group(3)
        if number:
            following = template[match.end():match.end() + 1]
            return f"${int(number)}" + ("\\" if following.isdigit() else "")
        if match.group(2):
            return f"${{{match.group(2)}}}"
        return _ESCAPED[match.group(4)] if match.group(4) else r"\$"
    return _TEMPLATE.sub(respell, template)
