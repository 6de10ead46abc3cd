"""Arithmetic on numbers and nothing else: + - * / % ** , a leading minus and brackets, by precedence climbing."""

from __future__ import annotations

import operator
import re

TOKEN = re.compile(r"\s*(?:(\d[\d_]*\.?\d*(?:[eE][+-]?\d+)?|\.\d+(?:[eE][+-]?\d+)?)|(\*\*|//|[-+*/%()])|(\S))")
#: Binding power and operation; of equal power the left one goes first, but for powers.
BINARY = {"+": (1, operator.add), "-": (1, operator.sub), "*": (2, operator.mul), "/": (2, operator.truediv), "%": (2, operator.mod), "**": (4, operator.pow)}
UNARY = 3
UNSUPPORTED, MALFORMED = "unsupported expression", "invalid syntax"


def tokens(text: str) -> list[float | int | str]:
    out: list[float | int | str] = []
    for number, sign, other in TOKEN.findall(text.strip()):
        if other or sign == "//":
            raise ValueError(UNSUPPORTED)
        if number:
            plain = number.replace("_", "")
            out.append(int(plain) if plain.isdigit() else float(plain))
        else:
            out.append(sign)
    return out


def evaluate(text: str) -> float | int:
    left = tokens(text)[::-1]  # the next token is the last

    def operand() -> float | int:
        token = left.pop() if left else None
        if isinstance(token, int | float):
            return token
        if token == "-":
            return -climb(UNARY)
        if token == "+":
            raise ValueError(UNSUPPORTED)
        if token != "(":
            raise ValueError(MALFORMED)
        value = climb(0)
        if not left or left.pop() != ")":
            raise ValueError(MALFORMED)
        return value

    def climb(least: int) -> float | int:
        value = operand()
        while left and left[-1] in BINARY and BINARY[left[-1]][0] > least:
            power, apply = BINARY[left.pop()]
            value = apply(value, climb(power - (power == 4)))
        return value

    found = climb(0)
    if left:
        raise ValueError(MALFORMED)
    if isinstance(found, complex):
        raise ValueError(UNSUPPORTED)
    return found
