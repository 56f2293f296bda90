"""One way to write text rules for two engines: Spark columns and the SQL that checks them.

A rule is a Python function of a dialect `d` and an expression. With SPARK it gives a
Column of built-in functions; with DUCK it gives SQL text. Patterns are in the dialect that
Java and RE2 share, see rules.py.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from functools import lru_cache, wraps
from itertools import count
from re import _parser as parser

from pyspark import SparkContext
from pyspark.sql import Column
from pyspark.sql import functions as F

_EDGE = r"(?:(?<=[A-Za-z0-9_])(?![A-Za-z0-9_])|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"


_WORD = "[A-Za-z0-9_]"


def java(pattern: str) -> str:
    """ASCII word boundaries (Java's are not), `$` at the very end only (Java's is not), and no deep recursion.

    A repeated group before `$` becomes possessive: Java then runs it in a loop. The rules
    repeat groups there that can match in one way only, so nothing else changes.
    """
    pattern = re.sub(r"\)([*+])\$(?=$|\)|\|)", r")\1+$", pattern)
    # an edge before or after a known word character looks one way; behind a literal, the literal is searched for first
    pattern = re.sub(r"(?<![\\\w])(\w+)\\b", rf"\1(?!{_WORD})", pattern)
    pattern = re.sub(r"^\\b(\w[\w -]*?)(?=[\w -][*+?{]|[^\w *+?{-]|$)", lambda m: f"{m[1]}(?<!{_WORD}{m[1]})", pattern)
    pattern = re.sub(r"(?<!\\)((?:\\\\)*)\\b", lambda m: m[1] + _EDGE, pattern)
    return re.sub(r"(?<!\\)\$(?=$|\)|\|)", r"\\z", pattern)


def alternatives(patterns: Iterable[str]) -> str:
    return "|".join(f"(?:{p})" for p in patterns)


# necessary literals -----------------------------------------------------------------


def _literals(parsed) -> list[frozenset[str]]:
    """Sets of literals of which every match has one each."""
    found, run = [], ""
    for op, value in [*parsed, (None, None)]:
        if op is parser.AT:  # anchors and word edges take no room
            continue
        if op is parser.LITERAL:
            run += chr(value)
            continue
        inner = []
        if op is parser.SUBPATTERN:
            if all(o is parser.LITERAL for o, _ in value[3]):
                run += "".join(chr(v) for _, v in value[3])
                continue
            inner = _literals(value[3])
        elif op is parser.IN and all(o is parser.LITERAL for o, _ in value):
            inner = [frozenset(chr(v) for _, v in value)]
        elif op in (parser.MAX_REPEAT, parser.MIN_REPEAT) and value[0] > 0:
            inner = _literals(value[2])
        elif op is parser.BRANCH:
            each = [_best(_literals(b)) for b in value[1]]
            inner = [frozenset().union(*each)] if all(each) else []
        if run:
            found.append(frozenset([run]))
            run = ""
        found += inner
    return found


def _best(sets: list[frozenset[str]]) -> frozenset[str]:
    """The most telling set; none if all have a single letter or blank."""
    telling = [s for s in sets if len(s) <= 16 and all(len(x) > 1 or not (x.isalnum() or x.isspace()) for x in s)]
    room = lambda x: len(x) + 2 * any(not (c.isalnum() or c.isspace()) for c in x)
    return max(telling, key=lambda s: (min(map(room, s)) / (1 + len(s) / 8), sorted(s)), default=frozenset())


@lru_cache(maxsize=4096)
def needles(pattern: str) -> tuple[str, ...]:
    """Literals one of which is in any text that the pattern matches, upper and lower case aside; none if there is no telling."""
    try:
        parsed = parser.parse(pattern)
    except re.error:  # notation that only the two engines share
        return ()
    # what only differs in what goes before the same literal needs that literal alone
    found = sorted({x.lower() for x in _best(_literals(parsed))}, key=len)
    return tuple(x for k, x in enumerate(found) if not any(y in x for y in found[:k]))


def is_literal(pattern: str) -> bool:
    return re.fullmatch(r"[a-z0-9 ]+", pattern) is not None


#: White space beyond ASCII's that counts as such.
WIDE_SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
ALL_SPACES = " \t\n\x0b\x0c\r" + WIDE_SPACES


def _outside(pattern: str) -> str:
    """A pattern without its groups, classes and escapes: whether a bar in it splits it all."""
    pattern = re.sub(r"\\.|\[(?:\\.|[^\]])*\]", "", pattern)
    while (inner := re.sub(r"\([^()]*\)", "", pattern)) != pattern:
        pattern = inner
    return pattern


class Sql:
    """A SQL expression with the operators that a Column has."""

    def __init__(self, text: str):
        self.text = text

    def __str__(self) -> str:
        return self.text

    def _with(self, op: str, other) -> Sql:
        return Sql(f"({self.text} {op} {quoted(other)})")

    def __and__(self, other):
        return self._with("AND", other)

    def __or__(self, other):
        return self._with("OR", other)

    def __invert__(self):
        return Sql(f"(NOT {self.text})")

    def __eq__(self, other):
        return self._with("=", other)

    def __ne__(self, other):
        return self._with("<>", other)

    def __lt__(self, other):
        return self._with("<", other)

    def __le__(self, other):
        return self._with("<=", other)

    def __gt__(self, other):
        return self._with(">", other)

    def __ge__(self, other):
        return self._with(">=", other)

    def __add__(self, other):
        return self._with("+", other)

    def __sub__(self, other):
        return self._with("-", other)

    def __mul__(self, other):
        return self._with("*", other)

    __hash__ = None


def quoted(value) -> str:
    if isinstance(value, Sql):
        return value.text
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, int | float):
        return str(value)
    if value is None:
        return "NULL"
    out = "'" + str(value).replace("'", "''") + "'"
    for c in "\n\r\t":
        out = out.replace(c, f"' || chr({ord(c)}) || '")
    return f"({out})" if "||" in out else out


class _Bound:
    """A column that is read from where it was computed once."""

    def __init__(self, column: Column):
        self.column = column


class SparkDialect:
    def lit(self, value) -> Column:
        return F.lit(value)

    def lower(self, t):
        return F.lower(t)

    def length(self, t):
        return F.length(t)

    def trim(self, t):
        """Strips all white space, not blanks alone."""
        return F.btrim(t, F.lit(ALL_SPACES))

    def _has(self, low, found: Iterable[str]):
        found = list(found)
        if len(found) > 1 and not isinstance(low, _Bound):
            return self.let(low, lambda v: self._has(_Bound(v), found))
        low, out = low.column if isinstance(low, _Bound) else low, None
        for x in found:
            out = F.contains(low, F.lit(x)) if out is None else out | F.contains(low, F.lit(x))
        return out

    def replace(self, t, pattern: str, by: str = "", icase: bool = False, lines: bool = False):
        flags = ("i" if icase else "") + ("m" if lines else "")
        by = re.sub(r"\\(\d)", r"$\1", by.replace("$", r"\$"))
        return F.regexp_replace(t, (f"(?{flags})" if flags else "") + java(pattern), by)

    def replaces(self, t, steps: Iterable[tuple[str, str]], icase: bool = False, lines: bool = False):
        """(pattern, replacement) after (pattern, replacement); texts with none of the literals they need are not searched."""
        steps = list(steps)

        def done(u):
            for pattern, by in steps:
                u = self.replace(u, pattern, by, icase, lines)
            return u

        each = [needles(p) for p, _ in steps]
        if not all(each):
            return done(t)
        found = dict.fromkeys(x for some in each for x in some)
        if any(c.isalpha() for x in found for c in x):
            return self.let(t, lambda u: F.when(self._has(F.lower(u), found), done(u)).otherwise(u))
        return self.let(t, lambda u: F.when(self._has(u, found), done(u)).otherwise(u))

    def looks_ahead(self, t, pattern: str, by: str, found: Iterable[str]):
        """Replace a pattern in Java's own notation, in texts that have one of `found`."""
        return self.let(t, lambda u: F.when(self._has(F.lower(u), found), F.regexp_replace(u, pattern, by)).otherwise(u))

    def matches(self, t, patterns: str | Iterable[str], icase: bool = True):
        """Patterns tied to the start share one test; each other one is tried where its literal is."""
        patterns = [patterns] if isinstance(patterns, str) else list(patterns)
        like = lambda u, p: u.rlike(("(?i)" if icase else "") + java(p))
        start = [p[1:] for p in patterns if p.startswith("^") and "|" not in _outside(p)]
        free = [p for p in patterns if not (p.startswith("^") and "|" not in _outside(p))]
        plain = [p for p in free if not icase and is_literal(p)]
        guarded = [(p, needles(p)) for p in free if p not in plain]
        bare = [p for p, found in guarded if not found]

        def test(u, low):
            parts = [like(u, "^(?:" + alternatives(start) + ")")] if start else []
            parts += [F.contains(u, F.lit(p)) for p in plain]
            parts += [self._has(_Bound(low), found) & like(u, p) for p, found in guarded if found]
            parts += [like(u, alternatives(bare))] if bare else []
            out = parts[0]
            for p in parts[1:]:
                out = out | p
            return out

        if len(guarded) == len(bare):
            return test(t, t) if bool(start) + len(plain) + bool(bare) == 1 else self.let(t, lambda u: test(u, u))
        return self.let(t, lambda u: self.let(F.lower(u), lambda low: test(u, low)))

    def count(self, t, pattern: str):
        return F.size(F.regexp_extract_all(t, F.lit(java(pattern)), F.lit(0)))

    def extract(self, t, pattern: str, group: int = 0):
        return F.regexp_extract(t, java(pattern), group)

    def contains(self, t, part):
        return F.contains(t, part if isinstance(part, Column) else F.lit(part))

    def concat(self, *parts):
        return F.concat(*(p if isinstance(p, Column) else F.lit(p) for p in parts))

    def when(self, *cases, otherwise=None):
        out = None
        for test, value in cases:
            value = value if isinstance(value, Column) else F.lit(value)
            out = F.when(test, value) if out is None else out.when(test, value)
        return out.otherwise(otherwise if isinstance(otherwise, Column) else F.lit(otherwise))

    def let(self, value, body: Callable):
        """body(value), with value computed once however often body reads it."""
        return F.element_at(F.transform(F.array(value), body), 1)

    def slice(self, t, start: int, n=None):
        return F.substring(t, start, 1 << 30 if n is None else n)

    def upper(self, t):
        return F.upper(t)

    def pad(self, t, width: int):
        return F.rpad(t, width, " ")

    def repeat_fold(self, t, times: int, body: Callable):
        return F.aggregate(F.sequence(F.lit(1), F.lit(times)), t, lambda acc, _: body(acc))

    def split(self, t, pattern: str):
        return F.split(t, java(pattern), -1)

    def words_kept(self, words, keep: Callable):
        return F.filter(words, keep)

    def each(self, items, body: Callable):
        return F.transform(items, body)

    def size(self, items):
        return F.size(items)

    def isin(self, t, values: Iterable[str]):
        return t.isin(*values)

    def item(self, items, k: int):
        """1 is the first, -1 the last."""
        return F.try_element_at(items, F.lit(k))

    def instr(self, t, part: str):
        return F.instr(t, part)


class DuckDialect:
    def __init__(self):
        self.names = count()

    def lit(self, value) -> Sql:
        return Sql(quoted(value))

    def _call(self, name: str, *args) -> Sql:
        return Sql(f"{name}({', '.join(quoted(a) for a in args)})")

    def lower(self, t):
        return self._call("lower", t)

    def upper(self, t):
        return self._call("upper", t)

    def pad(self, t, width: int):
        return self._call("rpad", t, width, " ")

    def length(self, t):
        return self._call("length", t)

    def trim(self, t):
        return self._call("trim", t, ALL_SPACES)

    def replace(self, t, pattern: str, by: str = "", icase: bool = False, lines: bool = False):
        return self._call("regexp_replace", t, pattern, by, "g" + ("i" if icase else "") + ("m" if lines else ""))

    def matches(self, t, patterns, icase: bool = True):
        p = patterns if isinstance(patterns, str) else alternatives(patterns)
        return self._call("regexp_matches", t, p, "i" if icase else "c")

    def replaces(self, t, steps, icase: bool = False, lines: bool = False):
        for pattern, by in steps:
            t = self.replace(t, pattern, by, icase, lines)
        return t

    def count(self, t, pattern: str):
        return Sql(f"len(regexp_extract_all({quoted(t)}, {quoted(pattern)}))")

    def extract(self, t, pattern: str, group: int = 0):
        return self._call("regexp_extract", t, pattern, group)

    def contains(self, t, part):
        return self._call("contains", t, part)

    def concat(self, *parts):
        return Sql("(" + " || ".join(quoted(p) for p in parts) + ")")

    def when(self, *cases, otherwise=None):
        body = " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in cases)
        return Sql(f"(CASE {body} ELSE {quoted(otherwise)} END)")

    def let(self, value, body: Callable):
        x = f"v{next(self.names)}"
        return Sql(f"list_transform([{quoted(value)}], lambda {x}: {body(Sql(x)).text})[1]")

    def slice(self, t, start: int, n=None):
        return self._call("substring", t, start) if n is None else self._call("substring", t, start, n)

    def repeat_fold(self, t, times: int, body: Callable):
        for _ in range(times):
            t = body(t)
        return t

    def split(self, t, pattern: str):
        return self._call("string_split_regex", t, pattern)

    def words_kept(self, words, keep: Callable):
        x = f"v{next(self.names)}"
        return Sql(f"list_filter({quoted(words)}, lambda {x}: {keep(Sql(x)).text})")

    def each(self, items, body: Callable):
        x = f"v{next(self.names)}"
        return Sql(f"list_transform({quoted(items)}, lambda {x}: {body(Sql(x)).text})")

    def size(self, items):
        return self._call("len", items)

    def isin(self, t, values):
        return Sql(f"({quoted(t)} IN ({', '.join(quoted(v) for v in values)}))")

    def item(self, items, k: int):
        return Sql(f"({quoted(items)})[{k}]")

    def instr(self, t, part: str):
        return self._call("instr", t, part)


SPARK, DUCK = SparkDialect(), DuckDialect()
_PLANNED: dict[tuple, Column] = {}


def _name(column: Column) -> str | None:
    """Of a column that is no more than a name, the name; not of one that belongs to a table."""
    try:
        node = column._jc.node().toString()
    except AttributeError:
        return None
    found = re.match(r"UnresolvedAttribute\(List\(([^()]*)\),None,false", node)
    return found and found[1]


def planned(rule: Callable) -> Callable:
    """A large rule is built once per named column: building takes a call to the JVM for each part of it."""

    @wraps(rule)
    def built(d, *args):
        names = tuple(_name(a) for a in args) if d is SPARK else (None,)
        if not all(names):
            return rule(d, *args)
        key = (rule, names, id(SparkContext._gateway))
        if key not in _PLANNED:
            _PLANNED[key] = rule(d, *args)
        return _PLANNED[key]

    return built
