"""The cheapest repair of a row of turns, by iterative-deepening A*.

A conversation is legal if the initials of its roles are nothing, or pairs of u and a with at most one s
before them. Edits in ASCII order: D deletes a row, I inserts an empty turn, K keeps a row, R gives it the
role that fits. Depth-first search tries edits in that order under a bound on cost; the first path that
ends legally is the ASCII-least of the cheapest ones.
"""

from __future__ import annotations

from array import array

BLANK, DUPLICATE, TRUNCATED = 1, 2, 3  # faults; 0 is none
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3  # costs; CUT_OFF for a truncated row that stays
#: Before any turn, behind s, u and a: where each initial leads, and the role that fits next.
START, AFTER_S, AFTER_U, AFTER_A = range(4)
STEPS = ({"s": AFTER_S, "u": AFTER_U}, {"u": AFTER_U}, {"a": AFTER_A}, {"u": AFTER_U})
FITS = ("user", "user", "assistant", "user")
#: What is to be inserted at the end.
TO_END = (0, 2 * INSERT, INSERT, 0)
NO_END = 1 << 40
#: A run of so many faultless turns of alternating u and a is kept but for its ends by every cheapest repair:
#: a row of it that isn't kept costs 3 at least, and 10 take any state to any other. So the search is cut there.
RUN = 16


class Search:
    """Cheapest edits of rows (initial, fault), from a state to a state (None: any legal end)."""

    def __init__(self, initials: str, faults, begin: int = START, end: int | None = None):
        self.initials, self.faults, self.begin, self.end = initials, faults, begin, end
        n = len(initials)
        self.n = n
        # Lower bounds: what the rows from i on cost in any case, and their first row that may stay.
        self.must, self.live = array("q", [0] * (n + 1)), array("q", [n] * (n + 1))
        for i in reversed(range(n)):
            gone = faults[i] in (BLANK, DUPLICATE)
            self.must[i] = self.must[i + 1] + (DELETE if gone else CUT_OFF if faults[i] == TRUNCATED else 0)
            self.live[i] = self.live[i + 1] if gone else i
        # And for neighbours among those rows that can't both stay as they are: each such pair takes an edit of its own if pairs share no row.
        self.pairs = array("q", [0] * (n + 2))
        for i in reversed(range(n)):
            if self.live[i] != i:
                self.pairs[i] = self.pairs[i + 1]
                continue
            j = self.live[i + 1]
            fits = (initials[i] == "a" if end is None else True) if j == n else (initials[i] + initials[j]) in ("su", "ua", "au")
            behind = 0 if j == n else self.pairs[j + 1]
            either = self.edit(i) if j == n else min(self.edit(i), self.edit(j))
            self.pairs[i] = max(self.pairs[i + 1], (0 if fits else either) + behind)
        self.known = array("q", [0] * (4 * (n + 1)))  # cost to the end, at least: from the heuristic, then from searches that failed

    def edit(self, i: int) -> int:
        """The least that a row's edit adds to what the row costs in any case."""
        return DELETE - CUT_OFF if self.faults[i] == TRUNCATED else REROLE

    def least(self, i: int, q: int) -> int:
        """A lower bound of the cost from here."""
        at = 4 * i + q
        if not self.known[at]:
            j = self.live[i]
            if j == self.n:
                found = TO_END[q] if self.end is None else 0
            else:
                first = 0 if self.initials[j] in STEPS[q] else self.edit(j)
                found = max(self.pairs[j], first + self.pairs[j + 1])
            self.known[at] = self.must[i] + found + 1
        return self.known[at] - 1

    def ended(self, i: int, q: int) -> bool:
        return i == self.n and (q in (START, AFTER_A) if self.end is None else q == self.end)

    def children(self, i: int, q: int):
        """(edit, cost, place, state) in ASCII order."""
        fit = STEPS[q][FITS[q][0]]
        if i == self.n:
            return (("I", INSERT, i, fit),) if self.end is None else ()
        fault, insert = self.faults[i], ("I", INSERT, i, fit)
        delete = ("D", DELETE, i + 1, q)
        if fault in (BLANK, DUPLICATE):
            return delete, insert
        more = CUT_OFF if fault == TRUNCATED else 0
        kept = STEPS[q].get(self.initials[i])
        rerole = ("R", REROLE + more, i + 1, fit)
        return (delete, insert, rerole) if kept is None else (delete, insert, ("K", KEEP + more, i + 1, kept), rerole)

    def run(self) -> tuple[int, str]:
        """(cost, edits)."""
        bound = self.least(0, self.begin)
        while (found := self.within(bound)) is None:
            bound = self.least(0, self.begin)  # raised by the search that failed
        return bound, found

    def within(self, bound: int) -> str | None:
        """The first path in ASCII order of at most this cost; else None, and failed states know more of their cost."""
        if self.ended(0, self.begin):
            return ""
        edits, way, spent = [], [(0, self.begin, iter(self.children(0, self.begin)))], [0]
        lows = [NO_END]
        while way:
            i, q, rest = way[-1]
            for name, cost, j, r in rest:
                g, low = spent[-1] + cost, self.least(j, r)
                if g + low > bound:
                    lows[-1] = min(lows[-1], cost + low)
                    continue
                if self.ended(j, r):
                    return "".join([*edits, name])
                edits.append(name)
                way.append((j, r, iter(self.children(j, r))))
                spent.append(g)
                lows.append(NO_END)
                break
            else:
                way.pop()
                g, low = spent.pop(), lows.pop()
                self.known[4 * i + q] = max(self.known[4 * i + q], low + 1)
                if way:
                    edits.pop()
                    lows[-1] = min(lows[-1], g - spent[-1] + low)
        return None


class Repair:
    """Cost and edits of rows that come one by one; rows are held only up to the middle of the next clean run."""

    def __init__(self, run: int = RUN):
        self.run, self.least = run, run // 2
        self.initials, self.faults, self.clean = [], [], 0
        self.state, self.cost, self.edits = START, 0, []

    def add(self, initial: str, fault: int) -> None:
        fits = not fault and initial in ("u", "a")
        alternates = fits and self.clean and self.initials and self.initials[-1] != initial
        self.clean = self.clean + 1 if alternates else int(fits)
        self.initials.append(initial)
        self.faults.append(fault)
        if self.clean == self.run:
            self.solve(len(self.initials) - self.least)
            self.clean = self.least

    def solve(self, n: int | None = None) -> None:
        """Settles the first n rows, of which the last is kept; without n all, to the conversation's end."""
        rows = self.initials if n is None else self.initials[:n]
        end = None if n is None else AFTER_U if rows[-1] == "u" else AFTER_A
        cost, edits = Search(rows, self.faults[: len(rows)], self.state, end).run()
        self.cost += cost
        self.edits.append(edits)
        self.initials, self.faults, self.state = self.initials[len(rows) :], self.faults[len(rows) :], end

    def done(self) -> tuple[int, str]:
        self.solve()
        return self.cost, "".join(self.edits)
