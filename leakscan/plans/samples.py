"""Lines that a rule's pattern matches, made from the pattern itself: a corpus on which every rule is met."""

from __future__ import annotations

import random
import string
from functools import cache

from re import _constants as C  # the parsed form of patterns
from re import _parser

from ..rules import Rule, default_rules

CHARACTERS = string.ascii_letters + string.digits + "_-./+=:~%@!*" + " \t"
#: Of a repetition without an upper bound: how many more than its least.
MORE = 10


def _allowed(items, c: str) -> bool:
    """Whether a character class, as parsed, has ``c``."""
    negated = bool(items) and items[0][0] is C.NEGATE
    kinds = {C.CATEGORY_SPACE: str.isspace, C.CATEGORY_DIGIT: str.isdigit, C.CATEGORY_WORD: lambda x: x.isalnum() or x == "_"}
    hit = any(
        (op is C.LITERAL and ord(c) == of) or (op is C.RANGE and of[0] <= ord(c) <= of[1]) or (op is C.CATEGORY and of in kinds and kinds[of](c))
        for op, of in items
    )
    return hit != negated


def _text(parsed, rnd: random.Random, variant: int) -> str:
    out = []
    for op, of in parsed:
        if op is C.LITERAL:
            out.append(chr(of))
        elif op is C.ANY:
            out.append("z")
        elif op is C.NOT_LITERAL:
            out.append(rnd.choice([c for c in string.ascii_letters if ord(c) != of]))
        elif op is C.IN:
            fits = [c for c in CHARACTERS if _allowed(of, c)]
            plain = [c for c in fits if c.isalnum()]
            if of[0][0] is C.NEGATE and rnd.random() < 0.2:  # what is only told by what it isn't gets other characters too
                plain = [c for c in fits if c in "_-+!*"] or plain
            out.append(rnd.choice(plain or fits or [chr(next(v for k, v in of if k is C.LITERAL))]))
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT):
            least, most, part = of
            n = least if most is not C.MAXREPEAT and least == most else least + MORE * (most is C.MAXREPEAT) * (least > 1)
            out += [_text(part, rnd, variant) for _ in range(max(n, int(most is C.MAXREPEAT)) if least else 0)]
        elif op is C.SUBPATTERN:
            out.append(_text(of[3], rnd, variant))
        elif op is C.BRANCH:
            out.append(_text(of[1][variant % len(of[1])], rnd, variant))
        else:
            raise ValueError(f"no sample for {op}")
    return "".join(out)


def sample(rule: Rule, variant: int) -> str:
    """A text that the rule's pattern matches, the same at every call."""
    return _text(_parser.parse(rule.regex), random.Random(f"{rule.id}:{variant}"), variant)


@cache
def sample_lines(variants: int = 3) -> tuple[tuple[int, str, str], ...]:
    """(number, rule id, line): ``variants`` matching lines of each built-in rule, then one with only its first keyword."""
    lines = []
    for r in default_rules():
        lines += [(r.id, f"x {sample(r, v)} ;") for v in range(variants)] + [(r.id, f"x {r.keywords[0]} ;")]
    return tuple((i, *x) for i, x in enumerate(lines))
