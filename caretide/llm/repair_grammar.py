"""Weighted interval parsing of a conversation's turns with a repair grammar in Chomsky normal form.

A conversation is to become ``(s?(ua)+)?``: nothing, or user and assistant by turns, after a system turn or not. A
nonterminal (p, q) derives the turns that lead from state p to state q of that order, so its rules are (p, r) -> (p, q)
(q, r), and (p, q) -> turn by an edit. A cell of the chart has for every nonterminal the least (cost, audit) of a span;
spans are combined bottom-up by length, over all places where they can be cut. Insertions have no turn: their closure
(p, q) -> "" is applied to every single turn, from both sides, which makes every longer span closed too.

The cost of an audit follows from its letters and the turns alone. So of two audits of one cell and one cost neither is
the start of the other, their order stays when something is put before or behind both, and the least cell of a span can be
put together from the least cells of its parts, wherever it is cut. That is why long conversations are parsed in pieces.
"""

from functools import lru_cache

#: States: nothing yet, after the system turn, after a user turn, after an assistant turn. All but 1 and 2 may end.
STATES, FIRST, LAST = range(4), 0, (0, 3)
#: Role initials that lead from a state to another one.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
#: Costs of edits, and what a truncated turn costs unless it is deleted. Fixed by the result contract.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: What may become of a turn: initials that stand for its role, and its fault.
FINE, CUT, GONE = "fine", "truncated", "gone"
ROLES = {"u": "user", "a": "assistant"}
#: Turns of a piece whose whole chart is filled.
PIECE = 12

Cell = tuple[int, str] | None
Cells = tuple[Cell, ...]
#: Symbols: a turn that has to go, and each initial with a whole or a truncated text; "-" is any other initial.
SYMBOLS = {(i, f): c for (i, f), c in zip([(i, f) for i in "sua-" for f in (FINE, CUT)], "sSuUaA-_", strict=True)}
MUST_GO = "x"
_BY_SYMBOL = {c: key for key, c in SYMBOLS.items()}


def symbol(initial: str, fault: str) -> str:
    return MUST_GO if fault == GONE else SYMBOLS[initial if initial in ("s", "u", "a") else "-", fault]


def _index(p: int, q: int) -> int:
    return p * len(STATES) + q


def _insertions() -> dict[tuple[int, int], Cell]:
    """The least insertions that lead from a state to another one."""
    best: dict[tuple[int, int], Cell] = {(p, p): (0, "") for p in STATES}
    for _ in STATES:
        for (p, q), cell in list(best.items()):
            for (state, initial), after in STEPS.items():
                if state == q and initial in ROLES:
                    found = (cell[0] + INSERT, cell[1] + "I")
                    best[p, after] = min(best.get((p, after), found), found)
    return best


_INSERTED = _insertions()
EMPTY: Cells = tuple(_INSERTED.get((p, q)) for p in STATES for q in STATES)
#: (p, r) -> (p, q) (q, r), for nonterminals that some span has: a state is never left towards an earlier one but 3 to 2.
_POSSIBLE = {(p, q) for p in STATES for q in STATES if p == q or (p, q) in _INSERTED or (p, q) == (0, 1)}
RULES = [(_index(p, r), _index(p, q), _index(q, r)) for p in STATES for q in STATES for r in STATES if {(p, q), (q, r)} <= _POSSIBLE]


def joined(left: Cells, right: Cells, into: list[Cell] | None = None) -> list[Cell]:
    """The cells of two neighbouring spans as one, the least of them and those in ``into``."""
    out = [None] * len(EMPTY) if into is None else into
    for to, a, b in RULES:
        x, y = left[a], right[b]
        if x is None or y is None:
            continue
        cost, old = x[0] + y[0], out[to]
        if old is None or cost < old[0]:
            out[to] = (cost, x[1] + y[1])
        elif cost == old[0] and (audit := x[1] + y[1]) < old[1]:
            out[to] = (cost, audit)
    return out


@lru_cache(maxsize=None)
def _turn(c: str) -> Cells:
    """What can become of one turn, with insertions on both sides."""
    out: list[Cell] = [None] * len(EMPTY)
    for p in STATES:
        out[_index(p, p)] = (DELETE, "D")
    if c != MUST_GO:
        initial, fault = _BY_SYMBOL[c]
        extra = TRUNCATED if fault == CUT else 0
        for (p, to), q in STEPS.items():
            if to == initial:
                out[_index(p, q)] = (KEEP + extra, "K")
            elif to in ROLES:
                out[_index(p, q)] = (REROLE + extra, "R")
    return tuple(joined(joined(EMPTY, out), EMPTY))


@lru_cache(maxsize=1 << 16)
def _span(turns: str) -> Cells:
    """The cells of a span of several turns from those of all its shorter spans."""
    out: list[Cell] = [None] * len(EMPTY)
    for cut in range(1, len(turns)):
        joined(chart_cell(turns[:cut]), chart_cell(turns[cut:]), out)
    return tuple(out)


def chart_cell(turns: str) -> Cells:
    return _span(turns) if len(turns) > 1 else _turn(turns)


def parsed(turns: str) -> Cells:
    """The cells of at most PIECE turns: the chart is filled bottom-up by span length. Equal spans, of this conversation or
    of another one, are filled once."""
    for length in range(2, len(turns) + 1):
        for at in range(len(turns) - length + 1):
            chart_cell(turns[at : at + length])
    return chart_cell(turns) if turns else EMPTY


class Chart:
    """The cells of all that was added so far, in order. Neighbouring spans are combined when they have grown to the
    same number of parts, so that long audits are copied a logarithmic number of times."""

    def __init__(self) -> None:
        self._spans: list[tuple[int, Cells]] = []

    def add(self, cells: Cells) -> None:
        self._spans.append((1, cells))
        while len(self._spans) > 1 and self._spans[-1][0] >= self._spans[-2][0]:
            (m, right), (n, left) = self._spans.pop(), self._spans.pop()
            self._spans.append((m + n, tuple(joined(left, right))))

    def add_turns(self, turns: str) -> None:
        for at in range(0, len(turns), PIECE):
            self.add(parsed(turns[at : at + PIECE]))

    def cells(self) -> Cells:
        out = None
        for _, cells in reversed(self._spans):
            out = cells if out is None else tuple(joined(cells, out))
        return EMPTY if out is None else out


def best(cells: Cells) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    return min(c for q in LAST if (c := cells[_index(FIRST, q)]) is not None)


def replayed(audit: str, rows: list[tuple[str, str]], state: int) -> tuple[list[tuple[str, str]], int]:
    """The (role, text) that an audit makes of rows, from a state, and the state after them."""
    out, at = [], 0
    for edit in audit:
        if edit == "D":
            at += 1
            continue
        if edit == "K":
            role, text = rows[at]
            initial = role[:1]
        else:
            initial = "a" if state == 2 else "u"
            role, text = ROLES[initial], rows[at][1] if edit == "R" else ""
        at += edit != "I"
        out.append((role, text))
        state = STEPS[state, initial]
    return out, state
