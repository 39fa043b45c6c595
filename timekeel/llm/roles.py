"""The role grammar of a conversation and its LR automaton.

    conversation -> (nothing) | turns
    turns        -> s pair | pair | turns pair
    pair         -> u a

Complete rules but those of `conversation` are reduced at once, so a stack is one of few.
"""

from __future__ import annotations

from functools import lru_cache

START = "conversation"
GRAMMAR = (
    (START, ()),
    (START, ("turns",)),
    ("turns", ("s", "pair")),
    ("turns", ("pair",)),
    ("turns", ("turns", "pair")),
    ("pair", ("u", "a")),
)
NAMES = {left for left, _ in GRAMMAR}

#: An item is a rule's number and how much of it has been read; a state is a set of items.
State = frozenset
#: States from the bottom to the top; at most four, for the grammar is left-recursive.
Stack = tuple


def closure(items: set[tuple[int, int]]) -> State:
    found, todo = set(items), list(items)
    while todo:
        rule, dot = todo.pop()
        for nxt in GRAMMAR[rule][1][dot:dot + 1]:
            for i, (left, _) in enumerate(GRAMMAR):
                if left == nxt and (i, 0) not in found:
                    found.add((i, 0))
                    todo.append((i, 0))
    return frozenset(found)


@lru_cache(None)
def goto(state: State, symbol: str) -> State | None:
    moved = {(r, d + 1) for r, d in state if GRAMMAR[r][1][d:d + 1] == (symbol,)}
    return closure(moved) if moved else None


@lru_cache(None)
def shift(stack: Stack, symbol: str) -> Stack | None:
    """The stack after reading a role's initial and reducing what is complete; None if it cannot follow."""
    top = goto(stack[-1], symbol)
    if top is None:
        return None
    stack += (top,)
    while done := [r for r, d in stack[-1] if d == len(GRAMMAR[r][1]) and GRAMMAR[r][0] != START]:
        left, right = GRAMMAR[done[0]]
        stack = stack[:len(stack) - len(right)]
        stack += (goto(stack[-1], left),)
    return stack


@lru_cache(None)
def accepts(stack: Stack) -> bool:
    return any(GRAMMAR[r][0] == START and d == len(GRAMMAR[r][1]) for r, d in stack[-1])


EMPTY: Stack = (closure({(i, 0) for i, (left, _) in enumerate(GRAMMAR) if left == START}),)


def stacks() -> list[Stack]:
    """One stack for each top that can be reached, the empty one first: the shallowest of those with that top.

    Stacks with one top that differ below it (a `u` after nothing, after `s` or after turns) go on alike.
    """
    found, todo = {EMPTY[-1]: EMPTY}, [EMPTY]
    while todo:
        now = todo.pop(0)
        for symbol in "sua":
            after = shift(now, symbol)
            if after and after[-1] not in found:
                found[after[-1]] = after
                todo.append(after)
    return list(found.values())


STACKS = stacks()
PLACE = {s[-1]: i for i, s in enumerate(STACKS)}
