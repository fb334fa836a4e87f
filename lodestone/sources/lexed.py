"""Declarations of languages with braces or ``end`` from tokens and scopes.

A table says for each language what its comments, strings and words look like and which words declare what; a
lexer drops comments and keeps strings whole, brackets are matched once, and one descent over the tokens
reads a declaration's head up to its body, notes where the body ends, and enters classes and namespaces.
Heads may take any number of lines; what stands in strings, comments and here-documents declares nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

_C_COMMENT = r"//[^\n]*|/\*.*?\*/"
_DOUBLE, _SINGLE = r'"(?:\\.|[^"\\])*"', r"'(?:\\.|[^'\\])*'"
_CHAR = r"'(?:\\[^']{1,10}|[^'\\])'"
_TRIPLE = r'"""(?:\\.|.)*?"""'
_BACK = r"`(?:\\.|[^`\\])*`"


@dataclass(frozen=True)
class Grammar:
    """What a language's parts look like.  ``types`` declare classes, ``spaces`` only hold declarations,
    ``extends`` come before bases; ``c_like`` functions have no word of their own."""

    comment: str = _C_COMMENT
    string: str = f"{_DOUBLE}|{_CHAR}"
    word: str = r"[^\W\d]\w*"
    types: frozenset[str] = frozenset()
    spaces: frozenset[str] = frozenset()
    functions: frozenset[str] = frozenset()
    imports: frozenset[str] = frozenset()
    extends: tuple[str, ...] = ()
    c_like: bool = False
    lines: bool = False
    nested: bool = False
    heredoc: str = ""
    doc: str = ""


def _set(words: str) -> frozenset[str]:
    return frozenset(words.split())


# The words of the languages.
GRAMMARS: dict[str, Grammar] = {
    "typescript": Grammar(string=f"{_DOUBLE}|{_SINGLE}|{_BACK}", word=r"[^\W\d][\w$]*|\$[\w$]*|\#\w+", types=_set("class interface type"), spaces=_set("namespace module"), functions=_set("function"), imports=_set("import"), extends=("extends",), c_like=True, lines=True, doc="/**"),
    "go": Grammar(string=f"{_DOUBLE}|{_BACK}|{_CHAR}", types=_set("type"), functions=_set("func"), imports=_set("import"), lines=True),
    "rust": Grammar(string=rf'b?r(?P<hash>#*)".*?"(?P=hash)|b?{_DOUBLE}|b?{_CHAR}', types=_set("struct enum trait union"), spaces=_set("mod"), functions=_set("fn"), imports=_set("use"), nested=True, doc="///"),
    "java": Grammar(string=f"{_TRIPLE}|{_DOUBLE}|{_CHAR}", types=_set("class record interface enum"), imports=_set("import"), extends=("extends",), c_like=True, doc="/**"),
    "kotlin": Grammar(string=f"{_TRIPLE}|{_DOUBLE}|{_CHAR}", types=_set("class object interface"), functions=_set("fun"), imports=_set("import"), lines=True, nested=True),
    "csharp": Grammar(string=rf'\$?@\$?"(?:""|[^"])*"|{_TRIPLE}|\$?{_DOUBLE}|{_CHAR}', types=_set("class struct interface record enum"), spaces=_set("namespace"), imports=_set("using"), extends=(":",), c_like=True),
    "php": Grammar(comment=rf"{_C_COMMENT}|\#(?!\[)[^\n]*|<\?(?:php)?|\?>", string=f"{_DOUBLE}|{_SINGLE}", word=r"\$?[^\W\d]\w*(?:\\\w+)*|\\\w+(?:\\\w+)*", types=_set("class interface trait enum"), spaces=_set("namespace"), functions=_set("function"), imports=_set("use"), extends=("extends",), heredoc=r"<<<\s*[\"']?(?P<tag>\w+)[\"']?"),
    "ruby": Grammar(comment=r"\#[^\n]*|^=begin\b.*?^=end\b[^\n]*", string=f"{_DOUBLE}|{_SINGLE}|%[wWiIqQ]?[\\[({{][^\\])}}]*[\\])}}]", word=r"[@$]{0,2}[^\W\d]\w*[?!]?(?!:(?!:))|[^\W\d]\w*:(?!:)", types=_set("class module"), functions=_set("def"), imports=_set("require require_relative include_recipe"), extends=("<",), lines=True, heredoc=r"<<[~-]?[\"']?(?P<tag>[A-Z_]\w*)[\"']?"),
    "swift": Grammar(string=rf'{_TRIPLE}|\#*{_DOUBLE}\#*', types=_set("class struct enum protocol actor extension"), functions=_set("func init deinit"), imports=_set("import"), extends=(":",), lines=True, nested=True),
    "c": Grammar(comment=rf"{_C_COMMENT}|^[ \t]*\#(?![ \t]*include)(?:\\\n|[^\n])*", types=_set("struct union enum"), c_like=True),
    "cpp": Grammar(comment=rf"{_C_COMMENT}|^[ \t]*\#(?![ \t]*include)(?:\\\n|[^\n])*", string=rf'R"(?P<hash>\w*)\(.*?\)(?P=hash)"|{_DOUBLE}|{_CHAR}', types=_set("class struct union enum"), spaces=_set("namespace extern"), extends=(":",), c_like=True),
    "bash": Grammar(comment=r"(?<![^\s;])\#[^\n]*", string=f"{_DOUBLE}|'[^']*'", word=r"[\w./$@%+:~-]+", functions=_set("function"), imports=_set("source ."), lines=True, heredoc=r"<<-?\s*[\"']?(?P<tag>\w+)[\"']?"),
    "puppet": Grammar(comment=r"\#[^\n]*|/\*.*?\*/", string=f"{_DOUBLE}|{_SINGLE}", word=r"\$?(?:::)?[^\W\d]\w*(?:::\w+)*", types=_set("class define node"), imports=_set("include require contain"), lines=True),
}
GRAMMARS["javascript"] = GRAMMARS["typescript"]
# Words before a bracket that call nothing.
CONTROL = _set("if for foreach while switch catch return match fn func fun function def elseif elsif unless until when case with using lock synchronized sizeof typeof new do else try throw await yield in is as not and or defer guard where super this assert echo print isset unset empty array list include include_once require require_once")
# Shell words that are no calls of functions.
SHELL_BUILTINS = _set("if then else elif fi for do done while until case esac in echo printf cd exit return local export source set unset shift read test true false break continue eval exec trap wait alias declare readonly function . [ [[ ]] time select typeset let pushd popd")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}


@dataclass(slots=True)
class Token:
    kind: str  # word, string, sign or line
    text: str
    line: int
    at: int
    end: int


@dataclass
class Declared:
    """A declaration: ``label`` Class, Function, Method, Import, Variable; ``owner`` the class it stands in."""

    label: str
    name: str
    line: int
    end: int
    owner: str = ""
    doc: str = ""
    signature: str = ""
    bases: list[str] = field(default_factory=list)
    calls: list[str] = field(default_factory=list)


@lru_cache(maxsize=32)
def _pattern(language: str) -> re.Pattern:
    g = GRAMMARS[language]
    parts = [("comment", g.comment), *([("heredoc", g.heredoc)] if g.heredoc else []), ("string", g.string), ("include", r"^[ \t]*\#[ \t]*include[^\n]*" if language in ("c", "cpp") else r"(?!)"), ("word", g.word), ("number", r"\d[\w.]*"), ("line", r"\n"), ("sign", r"=>|->|::|&&|\|\||\S")]
    return re.compile("|".join(f"(?P<{k}>{p})" for k, p in parts), re.S | re.M)


def tokens(text: str, language: str) -> tuple[list[Token], dict[int, str]]:
    """(tokens, the documenting comment that ends before each place that has one)."""
    g, pattern = GRAMMARS[language], _pattern(language)
    out, docs, at, line, waiting, held = [], {}, 0, 1, [], ""
    while m := pattern.search(text, at):
        line += text.count("\n", at, m.start())
        kind, at, first = m.lastgroup, m.end(), line
        kind = next(k for k in ("comment", "heredoc", "string", "include", "word", "number", "line", "sign") if m.groupdict().get(k) is not None)
        if kind == "comment":
            if g.nested and m[0].startswith("/*"):
                depth = 1
                at = m.start() + 2
                while depth and (n := re.compile(r"/\*|\*/").search(text, at)):
                    depth += 1 if n[0] == "/*" else -1
                    at = n.end()
                at = len(text) if depth else at
            if g.doc and m[0].startswith(g.doc):
                held = (held + "\n" if g.doc == "///" and held else "") + text[m.start() : at]
            elif g.doc != "///":
                held = ""
        elif kind == "heredoc":
            waiting.append(m["tag"])
            out.append(Token("string", m[0], first, m.start(), at))
        elif kind == "line":
            for tag in waiting:  # the lines of here-documents are no code
                n = re.compile(rf"^[ \t]*{re.escape(tag)}\b", re.M).search(text, at)
                at = n.end() if n else len(text)
            waiting = []
            if g.lines:
                out.append(Token("line", "\n", first, m.start(), m.end()))
        else:
            if held:
                docs[len(out)] = held
                held = ""
            out.append(Token("word" if kind == "number" else kind, m[0], first, m.start(), at))
        line += text.count("\n", m.start(), at)
    return out, docs


_ENDS = _set("class module def begin case for")
_MAYBE = _set("if unless while until")


def _matched(ts: list[Token], language: str) -> dict[int, int]:
    """Where each opening bracket is closed; for Ruby also where each block ends."""
    close: dict[int, int] = {}
    stack: list[int] = []
    blocks: list[int] = []
    loop = False
    for i, t in enumerate(ts):
        if t.kind == "sign" and t.text in _OPEN:
            stack.append(i)
        elif t.kind == "sign" and t.text in _CLOSE:
            k = next((k for k in range(len(stack) - 1, -1, -1) if _OPEN[ts[stack[k]].text] == t.text), None)
            if k is not None:  # brackets between that are never closed are passed over
                close[stack[k]] = i
                del stack[k:]
        elif language == "ruby" and t.kind == "word" and not (i and ts[i - 1].text in (".", "::")):
            fresh = not i or ts[i - 1].text in ("\n", ";", "=", "(", "then", "do", "else", "return", "&&", "||")
            if t.text in _ENDS or (t.text in _MAYBE and fresh) or (t.text == "do" and not loop):
                if not (t.text == "def" and _endless(ts, i)):
                    blocks.append(i)
                loop = loop or (t.text in ("while", "until", "for") and fresh)
            elif t.text == "end" and blocks:
                close[blocks.pop()] = i
        if t.kind == "line":
            loop = False
    return close


def _endless(ts: list[Token], i: int) -> bool:
    """Whether a Ruby method is an expression: an equals sign after its name and parameters."""
    depth = 0
    for k, t in enumerate(ts[i + 1 :], 1):
        depth += (t.text == "(") - (t.text == ")")
        if t.kind == "line" and not depth:
            return False
        if t.text == "=" and not depth:
            return k > 1 and ts[i + k - 1].text == ")" or k == 2
    return False


class _Reader:
    def __init__(self, text: str, language: str):
        self.text, self.language, self.g = text, language, GRAMMARS[language]
        self.ts, self.docs = tokens(text, language)
        self.close = _matched(self.ts, language)
        self.out: list[Declared] = []

    # -- helpers

    def skip(self, i: int) -> int:
        """The token after this one, or after what it opens."""
        return self.close[i] + 1 if i in self.close and self.ts[i].kind == "sign" else i + 1

    def past_types(self, i: int, j: int) -> int:
        """The token after type parameters in angle brackets, where there are some."""
        if i >= j or self.ts[i].text != "<":
            return i
        depth = 0
        for k in range(i, j):
            depth += (self.ts[k].text == "<") - (self.ts[k].text == ">")
            if not depth:
                return k + 1
        return i

    def head(self, i: int, j: int) -> tuple[int, str]:
        """(where the head that begins at ``i`` stops, what stops it): a body, an end, or '=' before a value."""
        k, seen, begun = i, False, False
        while k < j:
            t = self.ts[k]
            if self.language == "cpp" and t.text == "{" and begun and (self.ts[k - 1].kind == "word" or self.ts[k - 1].text == ">"):
                k = self.skip(k)  # a member's initialiser
                continue
            begun = begun or t.text == ":" and k > i and self.ts[k - 1].text in (")", "noexcept")
            if t.kind == "sign" and t.text in ("{", ";", "}", "=>"):
                return k, t.text
            if t.text == "=" and t.kind == "sign":
                return k, "="
            if t.kind == "line" and seen and not self.continues(k, j):
                return k, "\n"
            seen = seen or t.kind != "line"
            k = self.skip(k)
        return j, ""

    def continues(self, k: int, j: int) -> bool:
        """Whether a line's end lies within a head."""
        before = self.ts[k - 1].text
        after = next((self.ts[n].text for n in range(k + 1, j) if self.ts[n].kind != "line"), "")
        return before in (",", ":", "->", "extends", "where", "&", "|", "=") or after in ("{", ":", "->", "extends", "implements", "where", ",", ".") and self.language not in ("go", "bash")

    def calls(self, i: int, j: int) -> list[str]:
        """Last names of what is called between two tokens, in order."""
        found = []
        if self.language == "bash":
            fresh = True
            for t in self.ts[i:j]:
                if t.kind == "word" and fresh and t.text not in SHELL_BUILTINS and re.match(r"[A-Za-z_]", t.text) and "$" not in t.text:
                    if self.text[t.end : t.end + 1] not in ("=", "+"):
                        found.append(t.text)
                        fresh = False
                    continue
                fresh = t.kind == "line" or t.text in (";", "|", "&&", "||", "(", "{", "then", "do", "else", "!", "`", "&", "if", "elif", "while", "until")
            return found
        for k in range(i, j):
            t = self.ts[k]
            if t.kind != "word" or t.text in CONTROL or not re.match(r"[^\W\d$]|\\", t.text):
                continue
            before = self.ts[k - 1].text if k else ""
            n = k + 1
            if n < j and self.ts[n].text == "::" and n + 1 < j and self.ts[n + 1].text == "<":
                n = self.past_types(n + 1, j)
            after = self.ts[n] if n < len(self.ts) else None
            called = after is not None and after.kind == "sign" and after.text == "(" and (self.language != "ruby" or after.at == t.end)
            if before in ("function", "def", "fn", "func", "fun", "new", "class") or not called and not (self.language == "ruby" and before == "." or self.language in ("kotlin", "swift") and after is not None and after.text == "{" and before == "."):
                continue
            found.append(re.split(r"[.\\:]", t.text)[-1])
        return found

    def doc(self, i: int) -> str:
        raw = self.docs.get(i, "")
        lines = [re.sub(r"^\s*(?:/\*\*|///?!?|\*/|\*)\s?|\s*\*/\s*$", "", x).strip() for x in raw.splitlines()]
        return "\n".join(x for x in lines if x)

    def add(self, label: str, name: str, i: int, end: int, **more) -> Declared:
        last = self.ts[min(end, len(self.ts) - 1)]
        while last.kind == "line" and end > i:
            end -= 1
            last = self.ts[end]
        d = Declared(label, name, self.ts[i].line, last.line + last.text.count("\n") * (last.kind == "string"), **more)
        self.out.append(d)
        return d

    def signature(self, i: int, k: int) -> str:
        return " ".join(self.text[self.ts[i].at : self.ts[k - 1].end].split()) if k > i else ""

    def statement_end(self, k: int, j: int) -> int:
        """Where a value that begins at ``k`` ends."""
        began = False
        while k < j:
            t = self.ts[k]
            if t.text == ";" and t.kind == "sign":
                return k
            if t.kind == "line" and began and not self.continues(k, j):
                return k
            began = began or t.kind != "line"
            k = self.skip(k)
        return j

    # -- declarations

    def block(self, i: int, j: int, owner: str = "") -> None:
        """The declarations between two tokens."""
        while i < j:
            if self.ts[i].kind == "line" or self.ts[i].text in (";", "}", ")", ","):
                i += 1
                continue
            i = max(i + 1, self.ruby(i, j, owner) if self.language == "ruby" else self.one(i, j, owner))

    def one(self, i: int, j: int, owner: str) -> int:
        """Read the declaration or statement at ``i``; the token after it."""
        g = self.g
        k, stop = self.head(i, j)
        words = [n for n in self.outer(i, k) if self.ts[n].kind == "word"]
        first = self.ts[words[0]].text if words else ""
        if self.ts[i].kind == "include":
            self.add("Import", re.sub(r"^[ \t]*\#[ \t]*include\s*|[<>\"]", "", self.ts[i].text).split("//")[0].strip(), i, i)
            return i + 1
        if self.language == "go" and first in ("import", "type") and len(words) == 1 and i + 1 < j and self.ts[i + 1].text == "(":
            inner, end = i + 2, self.close.get(i + 1, j)
            while inner < end:
                if self.ts[inner].kind == "line":
                    inner += 1
                    continue
                stop_at = self.statement_end(inner, end)
                self.go_spec(first, inner, stop_at)
                inner = stop_at + 1
            return end + 1
        if self.language == "php" and first == "use" and owner:  # traits
            return self.statement_end(i, j) + 1
        if first in g.imports and not (self.language in ("csharp",) and "(" in [t.text for t in self.ts[i:k]]) or self.language == "bash" and self.ts[i].text == ".":
            return self.imported(i, j)
        if self.language == "typescript" or self.language == "javascript":
            self.required(i, self.statement_end(i, j))
        if self.language == "bash":
            return self.shell(i, j)
        at = next((n for n in words if self.ts[n].text in g.functions), None)
        type_at = next((n for n in words if self.ts[n].text in g.types and not (n > i and self.ts[n - 1].text in (".", "::"))), None)
        body_end = self.close.get(k, j) if stop == "{" else k
        space = next((n for n in words[:2] if self.ts[n].text in g.spaces), None)
        if space is not None and stop == "{" and self.language != "typescript" or space is not None and stop == "{" and len(words) > 1:
            self.block(k + 1, body_end)
            return body_end + 1
        if self.language == "rust" and "impl" in [self.ts[n].text for n in words[:3]] and stop == "{":
            self.block(k + 1, body_end, self.impl_of(i, k))
            return body_end + 1
        if self.language == "go" and first == "type":
            return self.go_spec("type", i + 1, self.statement_end(i, j)) or self.statement_end(i, j) + 1
        if at is not None and (type_at is None or at < type_at) and (self.language != "php" or not (stop == "=" and self.ts[k - 1].text.startswith("$"))):
            return self.function(i, j, k, stop, at, owner)
        if type_at is not None and not (self.language in ("c", "cpp") and stop != "{") and self.types_named(type_at):
            if not (self.language in ("c", "cpp") and self.c_name(i, k) is not None):
                return self.typed(i, j, k, stop, type_at, owner)
        if g.c_like:
            if self.language in ("typescript", "javascript"):
                if stop in ("=", "=>") and (end := self.arrow(i, j, k, owner)):
                    return end
                if not owner:
                    return (self.close.get(k, j) + 1) if stop == "{" else self.statement_end(i, j) + 1
            name_at = self.c_name(i, k)
            if name_at is not None and (stop in ("{", "=>") or stop == ";" and owner and self.language != "cpp"):
                return self.c_function(i, j, k, stop, name_at, owner)
        if stop == "{":
            end = self.close.get(k, j)
            if self.language in ("c", "cpp", "csharp", "java") and end + 1 < j and self.ts[end + 1].text != ";":
                return end + 1
            return end + 1
        if stop in ("=", "=>"):
            return self.statement_end(k, j) + 1
        return k + 1

    def outer(self, i: int, k: int) -> Iterator[int]:
        """Tokens of a head that stand in no bracket."""
        while i < k:
            yield i
            i = self.skip(i)

    def types_named(self, at: int) -> bool:
        return at + 1 < len(self.ts) and (self.ts[at + 1].kind in ("word", "string") or self.ts[at + 1].text == "{")

    def bases(self, i: int, k: int) -> list[str]:
        """The bases in a class head from ``i`` on: the first for languages with one, all after a colon."""
        for n in self.outer(i, k):
            if self.ts[n].text in self.g.extends and self.ts[n].kind in ("word", "sign"):
                found, depth, last = [], 0, ""
                for t in (self.ts[x] for x in self.outer(n + 1, k)):
                    depth += (t.text == "<") - (t.text == ">")
                    if depth or t.text == ">":
                        continue
                    if t.text in ("implements", "where", "with") or t.kind == "line" and last:
                        break
                    if t.text == ",":
                        found.append(last)
                        last = ""
                    elif t.kind == "word" and t.text not in ("public", "private", "protected", "virtual"):
                        last = t.text
                found.append(last)
                found = [re.split(r"[.\\:]", x)[-1] for x in found if x]
                return found if self.g.extends == (":",) else found[:1]
        return []

    def typed(self, i: int, j: int, k: int, stop: str, at: int, owner: str) -> int:
        """A class, interface, structure or the like, and what it holds."""
        word = self.ts[at].text
        n = at + 1
        while n < k and self.ts[n].text in ("class", "struct", "data", "companion"):  # enum class, record struct
            n += 1
        end = self.close.get(k, j) if stop == "{" else self.statement_end(k, j) if stop == "=" else k
        name = self.ts[n].text.strip("'\"") if n < k and self.ts[n].kind in ("word", "string") else ""
        if self.language in ("c", "cpp") and n < k and self.ts[n].kind == "word" and n + 1 < k and self.ts[n + 1].kind == "word" and self.ts[n + 1].text != "final":
            name = self.ts[k - 1].text if self.ts[k - 1].kind == "word" else name  # attributes before the name
        if not name and self.language in ("c", "cpp") and end + 1 < j and self.ts[end + 1].kind == "word":
            name = self.ts[end + 1].text  # typedef struct { ... } name;
        if name:
            doc = self.doc(i)
            if self.language in ("typescript", "javascript") and word != "class":
                doc = f"{word}: {doc}" if doc else word
            if self.language == "swift" and word == "extension":
                self.block(k + 1, end, name)
                return end + 1
            d = self.add("Class", name, i, end, owner=owner, doc=doc, signature=self.signature(i, k), bases=self.bases(self.past_types(n + 1, k), k))
            if self.language == "puppet":
                self.puppet(n, k, end, d)
                return end + 1
        if stop == "{" and word != "type":
            self.block(k + 1, end, name or owner)
        return end + 1

    def impl_of(self, i: int, k: int) -> str:
        """The type that a Rust impl is for."""
        at = next((n for n in range(i, k) if self.ts[n].text == "for"), None)
        if at is None:
            at = next(n for n in range(i, k) if self.ts[n].text == "impl")
            at = self.past_types(at + 1, k) - 1
        name = ""
        for n in range(at + 1, k):
            if self.ts[n].text in ("<", "where", "{"):
                break
            if self.ts[n].kind == "word" and self.ts[n].text not in ("dyn", "mut"):
                name = self.ts[n].text
        return name

    def function(self, i: int, j: int, k: int, stop: str, at: int, owner: str) -> int:
        """A function that a word declares."""
        n = at + 1
        if self.language == "go" and n < j and self.ts[n].text == "(":
            receiver = [self.ts[x].text for x in range(n + 1, self.close.get(n, j)) if self.ts[x].kind == "word"]
            pointed = [x for x in receiver if x]
            owner = (pointed[1] if len(pointed) > 1 else pointed[0]) if pointed else ""
            n = self.close.get(n, j) + 1
        n = self.past_types(n, k)
        if self.language == "kotlin":  # an extension's receiver
            while n + 2 < k and self.ts[self.past_types(n + 1, k)].text in (".", "?"):
                n = self.past_types(n + 1, k)
                while self.ts[n].text in (".", "?"):
                    n += 1
        while n < k and self.ts[n].text in ("*", "&"):
            n += 1
        name = self.ts[n].text if n < k and self.ts[n].kind == "word" else self.ts[at].text if self.ts[at].text in ("init", "deinit") else ""
        if self.ts[at].text in ("init", "deinit"):
            name = self.ts[at].text
        end = self.close.get(k, j) if stop == "{" else self.statement_end(k + 1, j) if stop in ("=", "=>") else k
        if stop == "{" and self.language == "go" and k > i and self.ts[k - 1].text in ("interface", "struct"):  # in a result type
            k, stop = self.head(end + 1, j)
            end = self.close.get(k, j) if stop == "{" else k
        if name:
            label = "Method" if owner else "Function"
            self.add(label, name, i, end, owner=owner, doc=self.doc(i), signature=self.signature(i, k), calls=self.calls(k + 1, end))
        return end + 1

    def c_name(self, i: int, k: int) -> int | None:
        """The name before the last parameter list of a head."""
        found = None
        for n in self.outer(i, k):
            if self.ts[n].text == "(" and n > i and self.ts[n - 1].kind == "word" and self.ts[n - 1].text not in CONTROL and self.ts[n - 1].text not in ("throws", "noexcept", "__attribute__", "alignas", "decltype", "requires"):
                if n >= 2 and self.ts[n - 2].text in ("@", ":", ",") and n - 2 >= i:  # an annotation, or a constructor's initialiser
                    if found is not None:
                        break
                    continue
                found = n - 1
                if self.language == "cpp":
                    break
            elif self.ts[n].text == "<" and found is None and n > i and self.ts[n - 1].kind == "word":
                m = self.past_types(n, k)
                if m < k and self.ts[m].text == "(" and self.ts[n - 1].text not in CONTROL and m > n:
                    found = n - 1
        return found

    def c_function(self, i: int, j: int, k: int, stop: str, at: int, owner: str) -> int:
        """A function by its shape: a name and a parameter list before a body."""
        name = self.ts[at].text
        if self.language == "cpp" and at - 1 >= i and self.ts[at - 1].text == "~":
            name = f"~{name}"
        if self.language == "cpp":
            n = at - 2 if name.startswith("~") else at - 1
            if n - 1 >= i and self.ts[n].text == "::" and self.ts[n - 1].kind == "word":
                owner = self.ts[n - 1].text
        end = self.close.get(k, j) if stop == "{" else self.statement_end(k + 1, j) if stop == "=>" else k
        label = "Method" if owner or self.language == "java" else "Function"
        self.add(label, name, i, end, owner=owner, doc=self.doc(i), signature=self.signature(i, k), calls=self.calls(k + 1, end))
        return end + 1

    def arrow(self, i: int, j: int, k: int, owner: str) -> int:
        """A name that is given a function or an arrow function; 0 where it isn't."""
        end = self.statement_end(k, j)
        eq = next((n for n in range(i, end) if self.ts[n].text == "=" and self.ts[n].kind == "sign"), None)
        if eq is None or eq != k:
            return 0
        names = [n for n in self.outer(i, eq) if self.ts[n].kind == "word" and self.ts[n].text not in ("export", "const", "let", "var", "default", "public", "private", "protected", "static", "readonly")]
        colon = next((n for n in self.outer(i, eq) if self.ts[n].text == ":"), eq)
        names = [n for n in names if n < colon]
        n = eq + 1
        while n < end and (self.ts[n].kind == "line" or self.ts[n].text == "async"):
            n += 1
        is_function = n < end and self.ts[n].text == "function"
        arrow = next((x for x in self.outer(n, end) if self.ts[x].text == "=>"), None)
        n = self.past_types(n, end)
        if not names or not is_function and (arrow is None or not (self.ts[n].text == "(" or self.ts[n].kind == "word" and n + 1 == arrow)):
            return 0
        body = next((x for x in self.outer(n if is_function else arrow, end) if self.ts[x].text == "{"), None)
        label = "Method" if owner else "Function"
        stop = body if body is not None else end
        self.add(label, self.ts[names[-1]].text, i, max(i, end - 1), owner=owner, doc=self.doc(i), signature=self.signature(i, stop), calls=self.calls(body + 1, self.close.get(body, end)) if body is not None else [])
        return end + 1

    # -- imports, and languages with ways of their own

    def imported(self, i: int, j: int) -> int:
        end = self.statement_end(i, j)
        ts = self.ts[i:end]
        strings = [t.text.strip("\"'`") for t in ts if t.kind == "string"]
        raw = " ".join(self.text[ts[0].end : ts[-1].end].split()) if len(ts) > 1 else ""
        if self.language in ("typescript", "javascript"):
            names = strings[-1:]
        elif self.language == "go":
            names = strings
        elif self.language == "ruby":
            names = strings[:1]
        elif self.language == "rust":
            at = next(n for n, t in enumerate(ts) if t.text == "use")
            names = [" ".join(self.text[ts[at].end : ts[-1].end].split())]
        elif self.language == "php" and "{" in raw:
            stem, _, rest = raw.partition("{")
            names = [f"{stem.strip()}{x.strip()}" for x in rest.rstrip("}").split(",")]
        elif self.language == "php":
            names = [x.split(" as ")[0].strip() for x in re.sub(r"^(?:function|const)\s+", "", raw).split(",")]
        elif self.language == "bash":
            names = [ts[1].text.strip("\"'")] if len(ts) > 1 else []
        elif self.language == "puppet":
            names = [x.strip(" '\"") for x in raw.split(",")]
        else:
            names = [re.sub(r"^(?:static|global)\s+|\s+as\s+\w+$", "", raw.split("=")[-1].strip())]
        for name in names:
            if name:
                self.add("Import", name, i, max(i, end - 1), signature=self.signature(i, end))
        return end + 1

    def required(self, i: int, end: int) -> None:
        for n in range(i, end - 2):
            if self.ts[n].text == "require" and self.ts[n + 1].text == "(" and self.ts[n + 2].kind == "string":
                self.add("Import", self.ts[n + 2].text.strip("\"'`"), n, n)

    def go_spec(self, what: str, i: int, end: int) -> int:
        ts = self.ts[i:end]
        if what == "import":
            for t in ts:
                if t.kind == "string":
                    self.add("Import", t.text.strip('"`'), i, i)
        elif ts:
            n = i + 1
            if n < end and self.ts[n].text == "[":
                n = self.skip(n)
            kind = self.ts[n].text if n < end else ""
            if kind in ("struct", "interface"):
                begin = i - 1 if i and self.ts[i - 1].text == "type" else i
                self.add("Class", ts[0].text, begin, end - 1, doc=kind)
        return end + 1

    def shell(self, i: int, j: int) -> int:
        ts = self.ts
        n = i + 1 if ts[i].text == "function" else i
        if n < j and ts[n].kind == "word" and (n > i or n + 2 < j and ts[n + 1].text == "(" and ts[n + 2].text == ")"):
            k = n + 1
            while k < j and (ts[k].kind == "line" or ts[k].text in ("(", ")")):
                k += 1
            if k < j and ts[k].text == "{":
                end = self.close.get(k, j)
                self.add("Function", ts[n].text, i, end, calls=self.calls(k + 1, end), signature=self.signature(i, k))
                return end + 1
        n = i
        while n < j and ts[n].text in ("export", "readonly", "declare", "local", "typeset") or n < j and n > i and ts[n].text.startswith("-"):
            n += 1
        if n < j and re.fullmatch(r"[A-Za-z_]\w*", ts[n].text) and self.text[ts[n].end : ts[n].end + 1] == "=":
            end = self.statement_end(n, j)
            value = self.text[ts[n].end + 1 : ts[end - 1].end].strip()
            self.add("Variable", ts[n].text, i, max(i, end - 1), signature=value)
            return end + 1
        return self.statement_end(i, j) + 1

    def puppet(self, n: int, k: int, end: int, d: Declared) -> None:
        """A class's parameters, the variables and includes in its body."""
        for m in range(n, k):
            if self.ts[m].text == "(":
                stop = self.close.get(m, k)
                for x in self.outer(m + 1, stop):
                    t = self.ts[x]
                    after_name = x + 1 >= stop or self.ts[x + 1].text in ("=", ",", ")") or self.ts[x + 1].kind == "line"
                    if t.text.startswith("$") and after_name and self.ts[x - 1].text not in ("=",):
                        self.add("Variable", t.text.lstrip("$"), x, x, owner=d.name)
                break
        for x in range(k + 1, min(end, len(self.ts) - 1)):
            t = self.ts[x]
            if t.text in self.g.imports and t.kind == "word" and (self.ts[x - 1].kind == "line" or self.ts[x - 1].text in ("{", ";")) and self.ts[x + 1].text != "=>":
                self.imported(x, end)
            elif t.text.startswith("$") and t.kind == "word" and x + 1 < end and self.ts[x + 1].text == "=" and self.ts[x - 1].text in ("\n", "{"):
                self.add("Variable", t.text.lstrip("$"), x, x, owner=d.name)

    def ruby(self, i: int, j: int, owner: str) -> int:
        ts, t = self.ts, self.ts[i]
        if i + 1 >= len(ts):
            return i + 1
        if t.text in self.g.imports and t.kind == "word":
            return self.imported(i, j)
        line_end = next((n for n in range(i, j) if ts[n].kind == "line" or ts[n].text == ";"), j)
        if t.text in ("private", "protected", "public", "module_function", "private_class_method") and i + 1 < j and ts[i + 1].text == "def":
            return i + 1
        end = self.close.get(i)
        if t.text in self.g.types and t.kind == "word":
            end = j if end is None else end
            if i + 1 < j and ts[i + 1].text == "<" and ts[i + 2].text == "<":  # class << self
                self.block(line_end, end, owner)
                return end + 1
            name = ts[i + 1].text
            n = i + 1
            if n + 2 < line_end and ts[n + 1].text == "::":
                parts = [ts[n].text]
                while n + 2 < line_end + 1 and ts[n + 1].text == "::":
                    n += 2
                    parts.append(ts[n].text)
                name = "::".join(parts)
            self.add("Class", name, i, end, owner=owner, signature=self.signature(i, line_end), bases=self.bases(i + 1, line_end))
            self.block(line_end, end, name)
            return end + 1
        if t.text == "def":
            n = i + 1
            while n + 2 < j and ts[n + 1].text == "." and ts[n + 1].at == ts[n].end:
                n += 2
            after = n + 1
            if after < j and ts[after].text == "=" and ts[after].at == ts[n].end and after + 1 < j and ts[after + 1].text == "(":
                name = f"{ts[n].text}="
            else:
                name = ts[n].text
            stop = self.close.get(after, after - 1) + 1 if after < j and ts[after].text == "(" else line_end
            end = (self.statement_end(i, j) - 1) if end is None else end
            self.add("Method" if owner else "Function", name, i, end, owner=owner, signature=self.signature(i, stop), calls=self.calls(stop, end))
            return end + 1
        return end + 1 if end is not None else line_end + 1


def declarations(text: str, language: str) -> list[Declared]:
    """What a source file declares, in order of place; a file that no bracket of closes is read to its end."""
    r = _Reader(text, language)
    r.block(0, len(r.ts))
    return r.out
