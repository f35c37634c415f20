"""Boolean query text: reading, postfix form, tree, flattening and canonical text.

Operands are positions in a list of terms. Operators bind, tightest first: `*` (required with optional), `&`, `|`, `-`;
all associate to the left. White space is dropped first, so digits on both sides of a blank are one number."""

from __future__ import annotations

import re
from dataclasses import dataclass

TIGHTNESS = {"-": 1, "|": 2, "&": 3, "*": 4}
MOST_CHARACTERS = 4095


class QueryError(ValueError):
    """The text is no query, or names a term that isn't given."""


def parse_rpn(text: str) -> list[str]:
    """The postfix form of a query; an operator without a right operand is only found when a tree is built."""
    squeezed = re.sub(r"[ \t\r\n\v\f]+", "", text)
    if len(squeezed) > MOST_CHARACTERS:
        raise QueryError("the query is too long")
    if bad := re.search(r"[^0-9*&|\-()]", squeezed):
        raise QueryError(f"unknown character {bad[0]!r}")
    output: list[str] = []
    waiting: list[str] = []
    operand_before = False
    for token in re.findall(r"\d+|.", squeezed):
        if token.isdigit():
            output.append(token)
            operand_before = True
        elif token == "(":
            if operand_before:
                raise QueryError("a parenthesis opens behind an operand")
            waiting.append(token)
        elif not operand_before:
            raise QueryError(f"{token!r} lacks what stands before it")
        elif token == ")":
            while waiting and waiting[-1] != "(":
                output.append(waiting.pop())
            if not waiting:
                raise QueryError("a parenthesis closes that never opened")
            waiting.pop()
        else:
            while waiting and waiting[-1] != "(" and TIGHTNESS[waiting[-1]] >= TIGHTNESS[token]:
                output.append(waiting.pop())
            waiting.append(token)
            operand_before = False
    if "(" in waiting:
        raise QueryError("a parenthesis stays open")
    return output + waiting[::-1]


@dataclass(frozen=True)
class Node:
    """op is one of `* & | -`, or T for the term at a position."""

    op: str
    children: tuple["Node", ...] = ()
    pos: int = -1

    def terms(self) -> set[int]:
        return {self.pos} if self.op == "T" else set().union(*(c.terms() for c in self.children))

    def to_text(self) -> str:
        return str(self.pos) if self.op == "T" else "(" + self.op.join(c.to_text() for c in self.children) + ")"


def parse(text: str, n_terms: int, optional: bool = True) -> Node | None:
    """The tree of a query over n_terms terms, None for an empty one. Without `optional`, `*` is an error."""
    stack: list[Node] = []
    for token in parse_rpn(text):
        if token.isdigit():
            if int(token) >= n_terms:
                raise QueryError(f"there is no term {token}")
            stack.append(Node("T", pos=int(token)))
        elif token == "*" and not optional:
            raise QueryError("this form of query has no *")
        elif len(stack) < 2:
            raise QueryError(f"{token!r} lacks an operand")
        else:
            right = stack.pop()
            stack.append(Node(token, (stack.pop(), right)))
    if len(stack) > 1:
        raise QueryError("operands without an operator between them")
    return stack[0] if stack else None


def flatten(node: Node) -> Node:
    """Nested & in & and | in | become one operator of many children; * and - stay binary."""
    children = [flatten(c) for c in node.children]
    if node.op in "&|":
        children = [g for c in children for g in (c.children if c.op == node.op else (c,))]
    return Node(node.op, tuple(children), node.pos)
