"""Declarations in source text of languages with braces (TypeScript, JavaScript, Go, Java): a small helper of files.extract_symbols.

Comments and strings are blanked first, then brackets are paired, so a brace or a word within a string or a comment declares
nothing. Not a parser: a regular expression literal with an unbalanced bracket shifts the ends of what is around it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

#: Words of each language that stand before a parenthesis without being called or declared.
KEYWORDS = {
    "go": set("if for switch select return func go defer range chan map interface struct make new case import type var const".split()),
    "java": set("if for while switch catch return new try throw super this synchronized assert case do else yield instanceof".split()),
    "typescript": set("if for while switch catch return function new typeof await async in of do else throw super case void yield import export delete".split()),
}
KEYWORDS["javascript"] = KEYWORDS["typescript"]

LITERALS = {
    "go": r"//[^\n]*|/\*.*?(?:\*/|\Z)|`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
    "java": r"//[^\n]*|/\*.*?(?:\*/|\Z)|\"\"\".*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
    "typescript": r"//[^\n]*|/\*.*?(?:\*/|\Z)|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
}
LITERALS["javascript"] = LITERALS["typescript"]

CLASSES = {
    "go": r"\btype\s++(?P<name>\w++)(?:\[[^\]\n]*\])?\s++(?:struct|interface)\b",
    "java": r"\b(?:class|interface|enum|record)\s+(?P<name>\w++)",
    "typescript": r"\b(?:class|interface)\s+(?P<name>\w++)",
}
CLASSES["javascript"] = CLASSES["typescript"]

IMPORTS = {
    "go": r"\bimport\s+(?:[\w.]+\s+)?[\"`]([^\"`\n]+)[\"`]",
    "java": r"^[ \t]*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;",
    "typescript": r"\b(?:import|export)\b(?:(?!\b(?:import|export)\b)[^;'\"()])*?\bfrom\s*['\"]([^'\"\n]+)['\"]|\bimport\s*\(?\s*['\"]([^'\"\n]+)['\"]|\brequire\s*\(\s*['\"]([^'\"\n]+)['\"]",
}
IMPORTS["javascript"] = IMPORTS["typescript"]

ARROW = r"(?<![\w.])(?P<name>\w++)\s*+(?::[^=;{}():]{0,400})?=\s*+(?:async\b\s*+)?(?:<[^<>]*>\s*+)?(?=\(|\w++\s*+=>)"
NAMED = r"(?<![\w.@#$])(?P<name>#?[A-Za-z_$][\w$]*+)\s*+(?:(?:<[^<>(){};]*>|\[[^\[\](){};]*\])\s*+)?\("
CALLED = r"(?<![\w.@$])((?:[A-Za-z_$][\w$]*\.)*[A-Za-z_$][\w$]*+)\s*+(?:<[\w.,\s\[\]?]*>)?\("


def blanked(text: str, language: str, strings: bool = True) -> str:
    """text with comments, and strings if asked for, as spaces; line ends stay, so places don't move."""

    def blank(m: re.Match) -> str:
        return m[0] if not strings and m[0][0] != "/" else re.sub(r"[^\n]", " ", m[0])

    return re.sub(LITERALS[language], blank, text, flags=re.DOTALL)


class Brackets:
    """Pairs of brackets, and which pair of braces a place lies in."""

    def __init__(self, text: str) -> None:
        self.closes: dict[int, int] = {}
        self.outer: dict[int, int] = {}
        stack: list[tuple[str, int]] = []
        braces: list[int] = []
        for m in re.finditer(r"[(){}]", text):
            if m[0] in "({":
                if m[0] == "{":
                    self.outer[m.start()] = braces[-1] if braces else -1
                    braces.append(m.start())
                stack.append((m[0], m.start()))
            elif stack and stack[-1][0] == {")": "(", "}": "{"}[m[0]]:
                kind, start = stack.pop()
                self.closes[start] = m.start()
                if kind == "{":
                    braces.pop()
        for _, start in stack:  # what isn't closed runs to the end
            self.closes[start] = len(text)
        self.opens = sorted(self.outer)
        self.stops = [m.start() for m in re.finditer(r"[{;}=]", text)]

    def stop(self, at: int) -> int:
        """The next place from at on of a brace, semicolon or equals sign; -1 if there is none."""
        i = bisect_right(self.stops, at - 1)
        return self.stops[i] if i < len(self.stops) else -1

    def around(self, at: int) -> Iterator[int]:
        """Braces around a place, the innermost first."""
        i = bisect_right(self.opens, at - 1) - 1
        brace = self.opens[i] if i >= 0 else -1
        while brace >= 0:
            if self.closes[brace] > at:
                yield brace
            brace = self.outer[brace]


def body(text: str, pairs: Brackets, after: int) -> int | None:
    """Where the braces of a function begin whose parameters end at after; None if it has none. Types in braces are stepped over."""
    at = after + 1
    while (stop := pairs.stop(at)) >= 0:
        if text.startswith("=>", stop):
            at = stop + 2
            continue
        if text[stop] != "{":
            return None
        if not re.search(r"(?:[:|&<,]|\binterface|\bstruct)\s*$", text[max(after + 1, stop - 40) : stop]):
            return stop
        at = pairs.closes[stop] + 1
    return None


def bases(clause: str) -> list[str]:
    """Names after extends and implements, in order, without their type parameters."""
    while (shorter := re.sub(r"<[^<>]*>", "", clause)) != clause:
        clause = shorter
    return [n for part in re.findall(r"\b(?:extends|implements)\b((?:(?!\b(?:extends|implements|permits)\b).)*)", clause, re.DOTALL) for n in re.findall(r"[\w.$]+", part)]


def symbols(path: str, language: str, text: str) -> list[tuple]:
    """Rows (path, language, qualified_name, kind, line, end_line, parent, decorators, edges) of one file, its module first."""
    module = re.sub(r"\.\w+$", "", path).strip("/").replace("/", ".")
    if language not in LITERALS:
        return [(path, language, module, "module", 1, text.count("\n") + 1, None, [], [])]
    code = blanked(text, language)
    pairs = Brackets(code)
    ends = [m.start() for m in re.finditer("\n", text)]
    line = lambda at: bisect_right(ends, at - 1) + 1

    spoken = blanked(text, language, strings=False)
    imports = {next(filter(None, m.groups())) for m in re.finditer(IMPORTS[language], spoken, re.MULTILINE)}
    if language == "go":
        for m in re.finditer(r"\bimport\s*\(", code):
            imports |= set(re.findall(r"[\"`]([^\"`\n]+)[\"`]", spoken[m.end() : pairs.closes[m.end() - 1]]))
    out = [(path, language, module, "module", 1, len(ends) + 1, None, [], sorted(("IMPORTS", i) for i in imports))]

    found: dict[int, tuple[str, str, int, list]] = {}  # place of the name: kind, owner that is told by the text, brace, edges
    bodies: dict[int, str] = {}  # braces of classes
    declared = {}  # brace: the last declaration before it
    for m in re.finditer(CLASSES[language], code):
        stop = pairs.stop(m.end())
        if stop >= 0 and code[stop] == "{":
            declared[stop] = m
    for brace, m in declared.items():
        if language == "go":
            inside = code[brace + 1 : pairs.closes[brace]]
            held = re.findall(r"^[ \t]*+\*?([\w.]++)[ \t]*$", inside, re.MULTILINE)
        else:
            held = bases(code[m.end() : brace])
        bodies[brace] = m["name"]
        found[m.start("name")] = ("class", "", brace, [("INHERITS", b) for b in held])

    names = set()
    heads = [(m, m.end() - 1) for m in re.finditer(NAMED, code)]
    if language in ("typescript", "javascript"):
        heads += [(m, m.end()) for m in re.finditer(ARROW, code)]
    for m, paren in heads:
        name, at = m["name"], m.start("name")
        before = code[max(0, at - 200) : at]
        head = re.split(r"[;{}]", before)[-1]
        arrow = not m[0].rstrip().endswith("(")
        if name in KEYWORDS[language] or at in found:
            continue
        if arrow:
            close = pairs.closes.get(paren, paren) if code[paren : paren + 1] == "(" else paren
            if not re.match(r"\)?\s*(?::[^=;{}]*)?\s*=>|\w+\s*=>", code[close : close + 200]):
                continue
            block = re.compile(r"=>\s*\{").match(code, code.index("=>", close))
            brace = block.end() - 1 if block else None
        else:
            close = pairs.closes[paren]
            brace = body(code, pairs, close)
            inner = next(pairs.around(at), None)
            if language == "go":
                if not re.search(r"\bfunc\s*(?:\([^()]*\)\s*)?$", head):
                    continue
            elif not re.search(r"\bfunction\s*\*?\s*$", head):
                if inner not in bodies or "=" in head or re.search(r"\bnew\s+$", head) or (brace is None and language != "java"):
                    continue  # a call, or a field's value
                if language == "java" and not re.search(r"[\w>\]]\s+$", head) and name != bodies[inner]:
                    continue
        receiver = re.search(r"\bfunc\s*\(\s*(?:\w+\s+)?\*?\s*(\w+)[^()]*\)\s*$", head) if language == "go" else None
        names.add(at)
        found[at] = ("function", receiver[1] if receiver else "", brace if brace is not None else -1, [])

    owners: dict[int, str] = {}
    for at in sorted(found):
        kind, owner, brace, edges = found[at]
        name = re.compile(r"#?[\w$]+").match(code, at)[0]
        parent = f"{module}.{owner}" if owner else next((owners[b] for b in pairs.around(at) if b in owners), module)
        qualified = f"{parent}.{name}"
        end = pairs.closes[brace] if brace >= 0 else at
        if brace >= 0:
            owners[brace] = qualified
        if kind == "function" and brace >= 0:
            calls = {c[1] for c in re.compile(CALLED).finditer(code, brace, end) if c[1] not in KEYWORDS[language] and c.start(1) not in names}
            edges = sorted(("CALLS", c) for c in calls)
        head = re.split(r"[;{}]", code[max(0, at - 400) : at])[-1]
        marks = re.findall(r"@([A-Za-z_][\w.]*)", head) if language != "go" else []
        out.append((path, language, qualified, kind, line(at), line(end), parent, marks, edges))
    return out
