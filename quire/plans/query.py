"""Query strings -> match trees.

A search string becomes a small tree of phrases combined with AND / OR /
NOT / NEAR. Plain keyword queries get the implicit-AND-of-clauses treatment
(hyphen compounds become phrases, thesaurus phrase grouping, synonym
expansion); a query with a double quote or an upper-case operator word is
read with the full-text operator syntax:

    phrase   := string ['*'] ('+' string ['*'])*
    near     := NEAR '(' phrase phrase ... [',' N] ')'
    unit     := [colspec ':'] (['^'] phrase | near | '(' expr ')')
    colspec  := name | '-' name | '{' name ... '}' | '-' '{' name ... '}'
    juxtaposed units are ANDed and bind tightest, then NOT, AND, OR.

Only the driver runs this module, on one query string at a time; the trees
are turned into DataFrame plans by :mod:`quire.operators.match`.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from quire import schema as S
from quire.functions.text import tokenize_py

# --- fixed values -------------------------------------------------------------
OPERATOR_WORDS = ("AND", "OR", "NOT", "NEAR")
# --------------------------------------------------------------------------------


class QueryError(ValueError):
    """The query string is not valid operator syntax."""


@dataclass(frozen=True)
class Phrase:
    tokens: tuple[str, ...]
    prefix: bool = False
    fields: tuple[int, ...] | None = None  # None = every indexed field
    initial: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = S.NEAR_DEFAULT


@dataclass(frozen=True)
class And:
    items: tuple


@dataclass(frozen=True)
class Or:
    items: tuple


@dataclass(frozen=True)
class Not:
    left: object
    right: object


@dataclass(frozen=True)
class Nothing:
    """Matches no document (the query had no searchable word)."""


NOTHING = Nothing()


# -- sanitising plain keyword queries ---------------------------------------------

# A blank-separated run with a hyphen and two or more words in it, or a word.
_SCAN = re.compile(r"(?<!\S)(?=\S*-)(?P<compound>[^\w*\s]*[\w*]+[^\w*\s]+[\w*]\S*)|(?P<word>[\w*]+)")


def sanitize(query: str) -> list[str]:
    """Search words of a query without quotes: runs of letters, digits, ``_``
    and ``*``; a hyphen compound is one quoted phrase."""

    def phrase(compound: str) -> str:
        return '"%s"' % re.sub(r"[^\w*]+", " ", compound).strip()

    return [phrase(m["compound"]) if m["compound"] else m["word"] for m in _SCAN.finditer(query)]


def is_quoted(word: str) -> bool:
    return word.startswith('"')


# -- operator syntax ------------------------------------------------------------

_LEX = re.compile(r'"((?:[^"]|"")*)"|([0-9A-Za-z_\x1a\u0080-\U0010ffff]+)|(\S)')


@dataclass
class _Lexeme:
    kind: str  # 'str', 'word', 'op'
    text: str


def _lex(q: str) -> list[_Lexeme]:
    out = []
    pos = 0
    q = q.strip()
    while pos < len(q):
        if q[pos].isspace():
            pos += 1
            continue
        m = _LEX.match(q, pos)
        if m is None:
            raise QueryError(f"unterminated string in {q!r}")
        if m.group(1) is not None:
            out.append(_Lexeme("str", m.group(1).replace('""', '"')))
        elif m.group(2) is not None:
            out.append(_Lexeme("word", m.group(2)))
        else:
            if m.group(3) == '"':
                raise QueryError(f"unterminated string in {q!r}")
            out.append(_Lexeme("op", m.group(3)))
        pos = m.end()
    return out


@dataclass
class _Parser:
    lex: list[_Lexeme]
    i: int = 0
    field_names: tuple[str, ...] = S.INDEX_FIELDS
    _all: tuple[int, ...] = field(default=(), init=False)

    def __post_init__(self):
        self._all = tuple(range(len(self.field_names)))

    def peek(self, k: int = 0) -> _Lexeme | None:
        j = self.i + k
        return self.lex[j] if j < len(self.lex) else None

    def take(self) -> _Lexeme:
        lx = self.peek()
        if lx is None:
            raise QueryError("unexpected end of query")
        self.i += 1
        return lx

    def is_kw(self, word: str, k: int = 0) -> bool:
        lx = self.peek(k)
        return lx is not None and lx.kind == "word" and lx.text == word

    def expect_op(self, ch: str) -> None:
        lx = self.take()
        if lx.kind != "op" or lx.text != ch:
            raise QueryError(f"expected {ch!r}, got {lx.text!r}")

    # expr := and ('OR' and)*
    def parse_or(self):
        items = [self.parse_and()]
        while self.is_kw("OR"):
            self.take()
            items.append(self.parse_and())
        return items[0] if len(items) == 1 else Or(tuple(items))

    def parse_and(self):
        items = [self.parse_not()]
        while True:
            if self.is_kw("AND"):
                self.take()
                items.append(self.parse_not())
            elif self.starts_unit():
                items.append(self.parse_not())
            else:
                break
        return items[0] if len(items) == 1 else And(tuple(items))

    def parse_not(self):
        left = self.parse_list()
        while self.is_kw("NOT"):
            self.take()
            left = Not(left, self.parse_list())
        return left

    def parse_list(self):
        items = [self.parse_unit()]
        while self.starts_unit() and not self.starts_group():
            items.append(self.parse_unit())
        return items[0] if len(items) == 1 else And(tuple(items))

    def starts_group(self) -> bool:
        lx = self.peek()
        return lx is not None and lx.kind == "op" and lx.text == "("

    def starts_unit(self) -> bool:
        lx = self.peek()
        if lx is None:
            return False
        if lx.kind == "str":
            return True
        if lx.kind == "word":
            return lx.text not in ("AND", "OR", "NOT")
        return lx.text in ("(", "^", "{", "-")

    def parse_colspec(self) -> tuple[int, ...] | None:
        """Column filter before ':' (or None when the unit has none)."""
        save = self.i
        negate = False
        lx = self.peek()
        if lx is not None and lx.kind == "op" and lx.text == "-":
            negate = True
            self.take()
            lx = self.peek()
        names: list[str] = []
        if lx is not None and lx.kind == "op" and lx.text == "{":
            self.take()
            while not (self.peek() is not None and self.peek().kind == "op" and self.peek().text == "}"):
                w = self.take()
                if w.kind not in ("word", "str"):
                    raise QueryError(f"bad column list near {w.text!r}")
                names.append(w.text)
            self.take()
        elif lx is not None and lx.kind in ("word", "str") and self.peek(1) is not None and self.peek(1).text == ":":
            names.append(self.take().text)
        else:
            if negate:
                raise QueryError("'-' must introduce a column filter")
            self.i = save
            return None
        self.expect_op(":")
        ids = []
        for n in names:
            if n.lower() not in self.field_names:
                raise QueryError(f"no such column: {n}")
            ids.append(self.field_names.index(n.lower()))
        if negate:
            ids = [c for c in self._all if c not in ids]
        return tuple(sorted(set(ids)))

    def parse_unit(self):
        cols = self.parse_colspec()
        lx = self.peek()
        if lx is None:
            raise QueryError("unexpected end of query")
        if lx.kind == "op" and lx.text == "(":
            self.take()
            node = self.parse_or()
            self.expect_op(")")
        elif lx.kind == "word" and lx.text == "NEAR" and self.peek(1) is not None and self.peek(1).text == "(":
            node = self.parse_near()
        else:
            initial = False
            if lx.kind == "op" and lx.text == "^":
                self.take()
                initial = True
            node = self.parse_phrase(initial)
        return restrict(node, cols) if cols is not None else node

    def parse_near(self):
        self.take()
        self.expect_op("(")
        phrases = []
        distance = S.NEAR_DEFAULT
        while True:
            lx = self.peek()
            if lx is None:
                raise QueryError("unterminated NEAR group")
            if lx.kind == "op" and lx.text == ")":
                self.take()
                break
            if lx.kind == "op" and lx.text == ",":
                self.take()
                num = self.take()
                if num.kind != "word" or not num.text.isdigit():
                    raise QueryError("NEAR distance must be a number")
                distance = int(num.text)
                self.expect_op(")")
                break
            phrases.append(self.parse_phrase(False))
        if not phrases:
            raise QueryError("empty NEAR group")
        if len(phrases) == 1:
            return phrases[0]
        return Near(tuple(phrases), distance)

    def parse_phrase(self, initial: bool) -> Phrase:
        toks: list[str] = []
        prefix = False
        while True:
            lx = self.take()
            if lx.kind not in ("str", "word") or (lx.kind == "word" and lx.text in ("AND", "OR", "NOT")):
                raise QueryError(f"syntax error near {lx.text!r}")
            toks.extend(tokenize_py(lx.text))
            prefix = False
            nxt = self.peek()
            if nxt is not None and nxt.kind == "op" and nxt.text == "*":
                self.take()
                prefix = True
                nxt = self.peek()
            if nxt is not None and nxt.kind == "op" and nxt.text == "+":
                self.take()
                continue
            break
        return Phrase(tuple(toks), prefix and bool(toks), None, initial)


def restrict(node, cols: tuple[int, ...]):
    """Apply a column filter to every phrase under ``node``."""
    if isinstance(node, Phrase):
        f = cols if node.fields is None else tuple(c for c in node.fields if c in cols)
        return Phrase(node.tokens, node.prefix, f, node.initial)
    if isinstance(node, Near):
        return Near(tuple(restrict(p, cols) for p in node.phrases), node.distance)
    if isinstance(node, (And, Or)):
        return type(node)(tuple(restrict(x, cols) for x in node.items))
    if isinstance(node, Not):
        return Not(restrict(node.left, cols), restrict(node.right, cols))
    return node


def parse(expr: str):
    """Operator syntax -> tree. Raises :class:`QueryError` on bad syntax."""
    p = _Parser(_lex(expr))
    if p.peek() is None:
        return NOTHING
    node = p.parse_or()
    if p.peek() is not None:
        raise QueryError(f"syntax error near {p.peek().text!r}")
    return node


# -- keyword queries --------------------------------------------------------------

SynonymLookup = Callable[[Iterable[str]], dict[str, list[str]]]


def no_thesaurus(terms: Iterable[str]) -> dict[str, list[str]]:
    return {}


def phrase_candidates(words: list[str], max_len: int = S.MAX_PHRASE_WORDS) -> list[str]:
    """Every lower-cased window of 1..max_len words (what grouping may ask)."""
    out = []
    for i in range(len(words)):
        for n in range(1, max_len + 1):
            if i + n <= len(words):
                out.append(" ".join(words[i : i + n]).lower())
    return out


def group_words(words: list[str], known: set[str] | dict, max_len: int = S.MAX_PHRASE_WORDS) -> list[list[str]]:
    """Words grouped into thesaurus phrases, longest and leftmost first.

    Every place is marked with the longest term of two or more words that
    starts there; from the left, marked places that no phrase covers yet
    become phrases, and the other uncovered words stay alone."""
    low = [w.lower() for w in words]
    marks = [
        max((n for n in range(2, max_len + 1) if i + n <= len(low) and " ".join(low[i : i + n]) in known), default=1)
        for i in range(len(low))
    ]

    def take(starts: list[int], i: int) -> list[int]:
        covered = bool(starts) and i < starts[-1] + marks[starts[-1]]
        return starts if covered else [*starts, i]

    return [words[i : i + marks[i]] for i in functools.reduce(take, range(len(words)), [])]


def term_node(term: str):
    """A search term (word or multi-word group) as a tree leaf."""
    return parse('"' + term.replace('"', '""') + '"') if " " in term else parse(term)


def synonym_node(syn: str):
    return Phrase(tuple(tokenize_py(syn)))


def keyword_clauses(words: list[str], lookup: SynonymLookup = no_thesaurus, n_syn: int = S.SEARCH_SYNONYMS):
    """Implicit-AND clauses of a sanitised plain query (no operator words)."""
    quoted = [w for w in words if is_quoted(w)]
    plain = [w for w in words if not is_quoted(w)]
    syns = lookup(phrase_candidates(plain)) if plain else {}
    clauses = [parse(w) for w in quoted]
    for g in group_words(plain, syns):
        term = " ".join(g)
        alts = [term_node(term)] + [synonym_node(s) for s in syns.get(term.lower(), [])[:n_syn]]
        clauses.append(alts[0] if len(alts) == 1 else Or(tuple(alts)))
    return clauses


def kind_of(query: str, words: list[str]) -> str:
    """How a query is read: 'syntax' as it stands, 'joined' as the syntax of its
    words (an operator among them), 'keywords', or 'nothing'."""
    if '"' in query:
        return "syntax"
    bare = {w.upper() for w in words if not is_quoted(w)}
    return "joined" if bare & set(OPERATOR_WORDS) else "keywords" if words else "nothing"


def _keywords(words: list[str], lookup: SynonymLookup):
    clauses = [c for c in keyword_clauses(words, lookup) if c != Phrase(())]
    return And(tuple(clauses)) if len(clauses) > 1 else clauses[0] if clauses else NOTHING


def build(query: str, lookup: SynonymLookup = no_thesaurus):
    """Query string -> match tree (``NOTHING`` when there is nothing to match)."""
    words = [] if '"' in query else sanitize(query)
    kind = kind_of(query, words)
    if kind == "keywords":
        return _keywords(words, lookup)
    return NOTHING if kind == "nothing" else parse(query if kind == "syntax" else " ".join(words))


def leaves(node) -> list:
    """Phrase / Near leaves in query order (duplicates kept)."""
    if isinstance(node, (Phrase, Near)):
        return [node]
    if isinstance(node, (And, Or)):
        return [x for item in node.items for x in leaves(item)]
    if isinstance(node, Not):
        return leaves(node.left) + leaves(node.right)
    return []


# -- trees as rows ------------------------------------------------------------------


def phrase_key(ph: Phrase) -> str:
    """A name of the phrase: its tokens, ``*`` for a prefix, and before them its
    fields and ``^``, if any. Tokens hold only letters and digits, so names of
    different phrases differ."""
    head = "" if ph.fields is None else "{%s} " % ",".join(map(str, ph.fields))
    return head + ("^ " if ph.initial else "") + " ".join(ph.tokens) + ("*" if ph.prefix else "")


def near_key(near: Near) -> str:
    return "NEAR(%s, %d)" % (" + ".join(map(phrase_key, near.phrases)), near.distance)


@dataclass
class Rows:
    """A match tree in rows: ``program`` in postfix order (``has`` pushes whether
    a slot is hit; ``and``, ``or`` and ``not`` take the last n values), the
    slots (slot, key, df key, scored) and the phrases and NEAR groups they name.
    Scored slots are in query order."""

    program: list[tuple[str, int]] = field(default_factory=list)
    slots: list[tuple[int, str, str, bool]] = field(default_factory=list)
    phrases: dict[str, Phrase] = field(default_factory=dict)
    nears: dict[str, Near] = field(default_factory=dict)

    def slot(self, key: str, df_key: str, scored: bool) -> int:
        self.slots.append((len(self.slots), key, df_key, scored))
        return len(self.slots) - 1

    def add(self, node) -> None:
        if isinstance(node, Phrase):
            key = phrase_key(node)
            self.phrases[key] = node
            self.program.append(("has", self.slot(key, key, True)))
        elif isinstance(node, Near):
            name = near_key(node)
            self.nears[name] = node
            for m, ph in enumerate(node.phrases):
                self.phrases[phrase_key(ph)] = ph
                self.slot(f"{name}#{m}", phrase_key(ph), True)
            self.program.append(("has", self.slot(f"{name}#", f"{name}#", False)))
        elif isinstance(node, (And, Or, Not)):
            parts = (node.left, node.right) if isinstance(node, Not) else node.items
            for x in parts:
                self.add(x)
            self.program.append((type(node).__name__.lower(), len(parts)))


def rows_of(query: str) -> Rows:
    """The match tree of a query in operator syntax as rows."""
    out = Rows()
    out.add(build(query))
    return out
