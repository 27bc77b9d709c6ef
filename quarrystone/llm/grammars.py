"""Grammars that tell whether a text is well-formed in a language.

A text becomes a string of one letter per token. A rule is a function of such a string and a position that
gives the position behind what it matches, or -1; choices are ordered, and nothing goes back into what was
matched. What holds no other rule is one regular expression; the next letter tells which alternatives can
match at all; and the results of the rules that lead to others of their kind are kept per position. Names
are not resolved.

Rules are written as ``name = alternatives``: 'x' is a token, ID a name, LIT a literal, a bare word another
rule; ( ) | * + ? are as usual, (= ...) and (! ...) look ahead, and N is a line end that may end a statement.
"""

from __future__ import annotations

import ast
import re
import sys
from collections.abc import Callable

from .grammar_rules import C, CPP, GO, JAVA, JAVASCRIPT, RUST, TYPESCRIPT

Rule = Callable[[str, int], int]
_ITEM = re.compile(r"'([^']+)'|([A-Za-z_]\w*)|\([=!]|\S")
_NAME = re.compile(r"[^\W\d]|[$_]")
_END = "\x00"  # behind the last letter
KEPT = frozenset("expr assignment type bound statement block qname specs exprpath pattern targs nexpr noblock typename".split())  # rules that are tried again at a place
DEPTH = 20_000  # calls within each other, enough for some 1,000 nested brackets


class Node:
    """A part of a rule: its kind, its parts, the letters it can begin with and whether it can be empty."""

    def __init__(self, kind: str, parts: list[Node] = (), value: str = ""):
        self.kind, self.parts, self.value = kind, list(parts), value
        self.first: set[str] = set()
        self.empty = kind in ("=", "!", "*", "?")
        self.flat: str | None = None  # the same as a regular expression, without other rules


class Grammar:
    """Functions of the rules of a language."""

    def __init__(self, text: str, letters: Callable[[str], str]):
        self.letters = letters
        sources = dict(re.split(r"\s+=\s+", rule, maxsplit=1) for rule in re.split(r"\n(?=\w+\s+=\s)", text.strip()))
        self.nodes = {name: self._parsed([m.group() for m in _ITEM.finditer(body)], sources) for name, body in sources.items()}
        changed = True
        while changed:  # what every part can begin with, to the fixed point
            changed = any([self._spread(n) for n in self.nodes.values()])
        self._flatten()
        self.kept: dict[str, dict[int, int]] = {}
        self.made: dict[str, list] = {name: [None] for name in self.nodes}
        for name, node in reversed(self.nodes.items()):  # callers stand before what they call
            self.made[name][0] = self._remembered(name, self._function(node))

    def match(self, flat: str) -> bool:
        try:
            return self.made["unit"][0](flat + _END, 0) == len(flat)
        finally:
            for kept in self.kept.values():
                kept.clear()

    def _parsed(self, items: list[str], rules: dict[str, str]) -> Node:
        def choice() -> Node:
            found = [sequence()]
            while items and items[0] == "|":
                items.pop(0)
                found.append(sequence())
            return found[0] if len(found) == 1 else Node("|", found)

        def sequence() -> Node:
            found = []
            while items and items[0] not in ("|", ")"):
                item = items.pop(0)
                if item in ("(", "(=", "(!"):
                    inner = choice()
                    items.pop(0)
                    node = inner if item == "(" else Node(item[1], [inner])
                elif item[0] == "'" or item in ("ID", "LIT", "MACRO", "LIFETIME", "N", "ANY"):
                    node = Node("set", value=self.letters(item))
                else:
                    if item not in rules:
                        raise ValueError(f"no rule {item}")
                    node = Node("rule", value=item)
                while items and items[0] in ("*", "+", "?"):
                    node = Node(items.pop(0), [node])
                found.append(node)
            return found[0] if len(found) == 1 else Node("seq", found)

        return choice()

    def _spread(self, node: Node) -> bool:
        changed = any([self._spread(p) for p in node.parts])
        before = len(node.first), node.empty
        if node.kind == "set":
            node.first |= set(node.value)
        elif node.kind == "rule":
            node.first |= self.nodes[node.value].first
            node.empty |= self.nodes[node.value].empty
        elif node.kind == "seq":
            for p in node.parts:
                node.first |= p.first if p.kind not in ("=", "!") else set()
                if not p.empty:
                    break
            node.empty = all(p.empty for p in node.parts)
        elif node.kind not in ("=", "!"):
            for p in node.parts:
                node.first |= p.first
            node.empty |= any(p.empty for p in node.parts) if node.kind == "|" else node.parts[0].empty
        return changed or before != (len(node.first), node.empty)

    def _flatten(self) -> None:
        """Marks the parts without rules; a rule that is such a part is put in place of its name."""
        changed = True
        while changed:
            changed = any([self._marked(n) for n in self.nodes.values()])

    def _marked(self, node: Node) -> bool:
        changed = any([self._marked(p) for p in node.parts])
        if node.flat is None:
            if node.kind == "set":
                node.flat = f"[{node.value}]" if len(node.value) > 1 else node.value
            elif node.kind == "rule":
                node.flat = self.nodes[node.value].flat
            elif all(p.flat is not None for p in node.parts):
                inner = [p.flat for p in node.parts]
                node.flat = "".join(inner) if node.kind == "seq" else f"(?>{'|'.join(inner)})" if node.kind == "|" else f"(?{node.kind}{inner[0]})" if node.kind in "=!" else f"(?>{inner[0]}){node.kind}+"
            changed |= node.flat is not None
        return changed

    def _remembered(self, name: str, rule: Rule) -> Rule:
        node = self.nodes[name]
        if name not in KEPT or node.flat is not None:
            return rule
        kept = self.kept.setdefault(name, {})

        def remembered(s: str, i: int) -> int:
            j = kept.get(i)
            if j is None:
                j = kept[i] = rule(s, i)
            return j

        return remembered

    def _function(self, node: Node) -> Rule:
        if node.flat is not None:
            return _expression(node)
        kind = node.kind
        if kind == "rule":
            made = self.made[node.value]
            return made[0] or (lambda s, i: made[0](s, i))
        if kind == "seq":
            return self._sequence(node)
        if kind == "|":
            return self._choice(node)
        inner, first, empty = self._function(node.parts[0]), frozenset(node.parts[0].first), node.parts[0].empty
        if kind == "=":
            return lambda s, i: i if inner(s, i) >= 0 else -1
        if kind == "!":
            return lambda s, i: -1 if inner(s, i) >= 0 else i
        if kind == "?":

            def maybe(s: str, i: int) -> int:
                if s[i] not in first:
                    return i
                j = inner(s, i)
                return i if j < 0 else j

            return maybe

        def repeated(s: str, i: int) -> int:
            while s[i] in first:
                j = inner(s, i)
                if j <= i:
                    return i
                i = j
            return i

        if kind == "*":
            return repeated

        def once(s: str, i: int) -> int:
            if not empty and s[i] not in first:
                return -1
            i = inner(s, i)
            return repeated(s, i) if i >= 0 else -1

        return once

    def _sequence(self, node: Node) -> Rule:
        parts, run = [], []
        for p in [*node.parts, None]:
            if p is not None and p.flat is not None:
                run.append(p)
                continue
            if run:
                whole = Node("seq", run)
                whole.flat = "".join(x.flat for x in run)
                parts.append(_expression(run[0] if len(run) == 1 else whole))
                run = []
            if p is not None:
                parts.append(self._function(p))
        if len(parts) == 2:
            a, b = parts

            def both(s: str, i: int) -> int:
                i = a(s, i)
                return b(s, i) if i >= 0 else -1

            return both
        steps = tuple(parts)

        def all_of(s: str, i: int) -> int:
            for step in steps:
                i = step(s, i)
                if i < 0:
                    return -1
            return i

        return all_of

    def _choice(self, node: Node) -> Rule:
        made = [(p, self._function(p)) for p in node.parts]
        letters = set().union(*(p.first for p in node.parts))
        always = tuple(f for p, f in made if p.empty)
        table = {x: tuple(f for p, f in made if p.empty or x in p.first) for x in letters}

        def one_of(s: str, i: int) -> int:
            for f in table.get(s[i], always):
                j = f(s, i)
                if j >= 0:
                    return j
            return -1

        return one_of


def _expression(node: Node) -> Rule:
    if node.kind == "set":
        held = node.value
        return lambda s, i: i + 1 if s[i] in held else -1
    match = re.compile(node.flat).match

    def found(s: str, i: int) -> int:
        m = match(s, i)
        return m.end() if m else -1

    return found


class _Letters(dict):
    """The letters of the tokens met so far, at most 300,000 of at most 40 characters each."""

    def __init__(self, letter: Callable[[str], str]):
        self.letter = letter

    def __missing__(self, token: str) -> str:
        letter = self.letter(token)
        if len(token) < 40:
            if len(self) > 300_000:
                self.clear()
            self[token] = letter
        return letter


class Language:
    """The lexer and the grammar of one language."""

    def __init__(self, spec: dict):
        self.letters: dict[str, str] = {}
        self.tokens = re.compile(spec["lexer"]).findall
        self.skip = re.compile(spec["skip"])
        self.literal, self.constant = re.compile(spec["literal"]), re.compile(spec.get("constant", r"(?!)"))
        self.lifetime = re.compile(spec.get("lifetime", r"(?!)"))
        self.hard = spec["hard"].split()
        # words that only some places reserve are names elsewhere
        self.soft = [w for w in dict.fromkeys(re.findall(r"'([A-Za-z_]\w*)'", spec["rules"])) if w not in self.hard]
        self.ends, self.prepare = spec.get("ends"), spec.get("prepare")
        for word in [*self.soft, *self.hard, *re.findall(r"'([^']+)'", spec["rules"])]:
            self._letter(word)
        self.grammar = Grammar(spec["rules"], self._set)
        if self.ends:
            before, after = ("".join(self._class(w) for w in side.split()) for side in self.ends)
            self.line_end = re.compile(f"(?<=[{before}])N+(?![N{after}])")
        self.known = _Letters(self.letter)

    def _letter(self, token: str) -> str:
        if token not in self.letters:
            self.letters[token] = chr(0xE000 + len(self.letters))
        return self.letters[token]

    def _class(self, word: str) -> str:
        return {"ID": "iM" + "".join(map(self._letter, self.soft)), "LIT": "d"}.get(word) or self._letter(word)

    def _set(self, item: str) -> str:
        """The letters that an item of a rule stands for."""
        if item[0] == "'":
            return self._letter(item[1:-1])
        if item == "ANY":
            brackets = {self._letter(x) for x in "()[]{}"}
            return "".join(x for x in [*"idMLN", *self.letters.values()] if x not in brackets)
        return self._class("ID") if item == "ID" else {"LIT": "d", "MACRO": "M", "LIFETIME": "L", "N": "N"}[item]

    def letter(self, token: str) -> str:
        """One letter for a token, none for what is skipped, NUL for what no text may hold."""
        if token in self.letters:
            return self.letters[token]
        if token == "\n":
            return "N" if self.ends else ""
        if self.skip.match(token):
            return ""
        if self.literal.match(token):
            return "d"
        if self.lifetime.match(token):
            return "L"
        if _NAME.match(token):
            return "M" if self.constant.match(token) else "i"
        return _END

    def parses(self, text: str) -> bool:
        if self.prepare:
            text = self.prepare(text)
        flat = "".join(map(self.known.__getitem__, self.tokens(text)))
        if _END in flat:
            return False
        if self.ends:
            flat = self.line_end.sub("\x01", flat).replace("N", "").replace("\x01", "N")
        usual = sys.getrecursionlimit()
        sys.setrecursionlimit(max(usual, DEPTH))
        try:
            return self.grammar.match(flat)
        except RecursionError:  # nested too deeply to be told
            return True
        finally:
            sys.setrecursionlimit(usual)


LANGUAGES = {n: Language(s) for n, s in (("java", JAVA), ("c", C), ("cpp", CPP), ("javascript", JAVASCRIPT), ("typescript", TYPESCRIPT), ("rust", RUST), ("go", GO))}
RANKING = {
    "python": "def self elif None True False import from async", "java": "public private protected class void int long var String new final", "c": "include struct const char int long void size_t define",
    "cpp": "std include auto const string namespace class void", "javascript": "const let function export import from of", "typescript": "const export string number any unknown function interface",
    "rust": "fn let pub impl use mut usize match struct crate", "go": "func package import range string error nil struct return",
}
_RANKING = {k: frozenset(v.split()) for k, v in RANKING.items()}


def _python(text: str) -> bool:
    first = next((x for x in text.split("\n") if x.strip() and not x.strip().startswith("#")), "")
    if first[:1] in (" ", "\t"):  # a method stands inside its class
        text = "class _:\n" + text
    try:
        ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return False
    return True


def parses(text: str, language: str) -> bool:
    """Whether a complete excerpt is well-formed; a byte-order mark and CRLF are allowed, a blank text is well-formed."""
    text = text.removeprefix("﻿").replace("\r\n", "\n")
    if not text.strip():
        return True
    return _python(text) if language == "python" else LANGUAGES[language].parses(text)


def verdict(text: str, language: str) -> str:
    """``ok``, the language the text really is in, or ``corrupt``.

    A text that its own language accepts is ok whatever else accepts it. All other grammars are tried in
    order of their usual words in the text, whether they share any with it or not; the first that accepts
    it names the language. A text nested deeper than the grammars can follow counts as well-formed.
    """
    if parses(text, language):
        return "ok"
    words = set(re.findall(r"[A-Za-z_]\w*", text))
    for other in sorted(_RANKING, key=lambda k: -len(words & _RANKING[k]) / len(_RANKING[k])):
        if other != language and parses(text, other):
            return other
    return "corrupt"
