"""Chat formatting by a template compiler.

Templates are text with `{{ expression }}` and `{% statement %}` tags:
for/endfor over a list, if/elif/else/endif, set, and generation/endgeneration
around what a model is to learn. Expressions know names, literals, attribute
and item access, + ~ == != < and or not, and the filters upper, lower, trim,
length, escape and escape_name. Nothing else exists in the language: no calls, no imports,
no names beginning with an underscore, so a template can only read its data.

`parse` makes a syntax tree, `fold` evaluates what is constant and joins
adjacent text, `compile_template` turns the tree into nested Python closures
which append to an output with its generation spans.

Control strings inside texts are escaped by a backslash before each of their
first characters, and backslashes by doubling, so `unescape` gives every text
back and a marker in the output is always one of the template's own.

Defined results: null text is empty; a conversation's rows go by turn, ties by
role then text; null role is "user"; an unknown role is kept; rows without
conv_id form one conversation with id null; an empty table gives the added
conversation only; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vivaspark.llm.common import arrow_rows, table

#: Marks that only the template may write.
MARKS = ("### ", "</turn>")
DEFAULT = "{% for m in messages %}### {{ m.role | escape_name }}: {% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}{{ ' </tu' ~ 'rn>' }}\n{% endfor %}"
#: What a text may not hold unescaped: a mark's first character, wherever it stands, or the escape itself.
_UNSAFE = re.compile(r"[\\#<]")
_SAFE = re.compile(r"\\(.)", re.S)
_UNSAFE_NAME = re.compile(r"[\\#<:]")


def escape(text: str) -> str:
    return _UNSAFE.sub(lambda m: "\\" + m.group(), text)


def escape_name(text: str) -> str:
    """For roles, which a colon ends."""
    return _UNSAFE_NAME.sub(lambda m: "\\" + m.group(), text)


def unescape(text: str) -> str:
    return _SAFE.sub(r"\1", text)


class TemplateError(ValueError):
    """A template that the language does not allow."""


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_LEX = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<number>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[-+~<.|()\[\]]))")
FILTERS: dict[str, Callable] = {"upper": str.upper, "lower": str.lower, "trim": str.strip, "length": len, "escape": escape, "escape_name": escape_name}


class _Expression:
    """Recursive descent over one tag's tokens; trees are tuples (kind, ...)."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            m = _LEX.match(source, at)
            if not m or m.end() == at:
                raise TemplateError(f"not understood: {source[at:]!r}")
            self.tokens.append((m.lastgroup, m.group(m.lastgroup)))
            at = m.end()
        self.at = 0

    def peek(self, *values: str) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self) -> tuple[str, str]:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends too soon")
        self.at += 1
        return self.tokens[self.at - 1]

    def whole(self):
        tree = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"left over: {self.tokens[self.at][1]!r}")
        return tree

    def _chain(self, below, *ops: str):
        tree = below()
        while self.peek(*ops):
            tree = ("binary", self.take()[1], tree, below())
        return tree

    def choice(self):
        return self._chain(self.both, "or")

    def both(self):
        return self._chain(self.negation, "and")

    def negation(self):
        if self.peek("not"):
            self.take()
            return ("not", self.negation())
        return self._chain(self.sum, "==", "!=", "<")

    def sum(self):
        return self._chain(self.filtered, "+", "~")

    def filtered(self):
        tree = self.postfix()
        while self.peek("|"):
            self.take()
            _, name = self.take()
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            tree = ("filter", name, tree)
        return tree

    def postfix(self):
        kind, value = self.take()
        if kind == "text":
            tree = ("constant", _SAFE.sub(lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1]))
        elif kind == "number":
            tree = ("constant", int(value))
        elif kind == "name":
            tree = ("constant", value == "true") if value in ("true", "false") else ("name", _allowed(value))
        elif value == "(":
            tree = self.choice()
            if self.take()[1] != ")":
                raise TemplateError("a parenthesis stays open")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while self.peek(".", "["):
            if self.take()[1] == ".":
                tree = ("item", tree, ("constant", _allowed(self.take()[1])))
            else:
                tree = ("item", tree, self.choice())
                if self.take()[1] != "]":
                    raise TemplateError("a bracket stays open")
        return tree


def _allowed(name: str) -> str:
    if name.startswith("_"):
        raise TemplateError(f"name not allowed: {name!r}")
    return name


def parse(source: str) -> list:
    """Syntax tree: a list of (kind, ...) statements."""
    root: list = []
    stack: list[tuple[str, list]] = [("root", root)]
    at = 0
    for m in _TAG.finditer(source):
        body = stack[-1][1]
        if m.start() > at:
            body.append(("text", source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            body.append(("emit", _Expression(m[1]).whole()))
            continue
        word, _, rest = m[2].strip().partition(" ")
        if word == "for":
            f = re.fullmatch(r"\s*([A-Za-z]\w*)\s+in\s+(.*)", rest, re.S)
            if not f:
                raise TemplateError(f"for: {rest!r}")
            body.append(("for", f[1], _Expression(f[2]).whole(), inner := []))
            stack.append(("for", inner))
        elif word == "if":
            body.append(("if", [(_Expression(rest).whole(), inner := [])]))
            stack.append(("if", inner))
        elif word in ("elif", "else") and stack[-1][0] == "if":
            stack.pop()
            test = _Expression(rest).whole() if word == "elif" else ("constant", True)
            stack[-1][1][-1][1].append((test, inner := []))
            stack.append(("if", inner))
        elif word == "set":
            name, _, value = rest.partition("=")
            body.append(("set", _allowed(name.strip()), _Expression(value).whole()))
        elif word == "generation":
            body.append(("generation", inner := []))
            stack.append(("generation", inner))
        elif word.startswith("end") and stack[-1][0] == word[3:]:
            stack.pop()
        else:
            raise TemplateError(f"unexpected statement {word!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} without its end")
    if at < len(source):
        root.append(("text", source[at:]))
    return root


_OPS: dict[str, Callable] = {"+": lambda a, b: a + b, "~": lambda a, b: f"{a}{b}", "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b}


def fold_expression(e):
    """The same expression with its constant parts evaluated."""
    if e[0] == "binary":
        op, a, b = e[1], fold_expression(e[2]), fold_expression(e[3])
        if a[0] == "constant" and op in ("and", "or"):
            return b if bool(a[1]) == (op == "and") else a
        if a[0] == b[0] == "constant":
            try:
                return ("constant", _OPS[op](a[1], b[1]))
            except TypeError as e:
                raise TemplateError(f"{a[1]!r} {op} {b[1]!r}: {e}") from None
        return ("binary", op, a, b)
    if e[0] in ("not", "filter"):
        a = fold_expression(e[-1])
        if a[0] == "constant":
            return ("constant", not a[1] if e[0] == "not" else FILTERS[e[1]](a[1]))
        return (*e[:-1], a)
    if e[0] == "item":
        return ("item", fold_expression(e[1]), fold_expression(e[2]))
    return e


def fold(body: list) -> list:
    """The same statements: constants printed, dead branches gone, adjacent text joined."""
    out: list = []

    def add(s) -> None:
        if s[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + s[1])
        elif s != ("text", ""):
            out.append(s)

    for s in body:
        if s[0] == "emit":
            e = fold_expression(s[1])
            add(("text", str(e[1])) if e[0] == "constant" else ("emit", e))
        elif s[0] == "if":
            arms = []
            for test, inner in s[1]:
                test = fold_expression(test)
                if test[0] != "constant" or test[1]:
                    arms.append((test, fold(inner)))
                if test[0] == "constant" and test[1]:
                    break
            if arms and arms[0][0][0] == "constant":
                for x in arms[0][1]:
                    add(x)
            elif arms:
                add(("if", arms))
        elif s[0] == "for":
            add(("for", s[1], fold_expression(s[2]), fold(s[3])))
        elif s[0] == "generation":
            add(("generation", fold(s[1])))
        elif s[0] == "set":
            add(("set", s[1], fold_expression(s[2])))
        else:
            add(s)
    return out


class Output:
    """Rendered parts and the spans, in characters, that generation tags enclosed."""

    def __init__(self):
        self.parts, self.size, self.spans = [], 0, []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)


def _expression(e) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "constant":
        value = e[1]
        return lambda scope: value
    if kind == "name":
        name = e[1]
        return lambda scope: scope[name]
    if kind == "item":
        of, key = _expression(e[1]), _expression(e[2])
        return lambda scope: of(scope)[key(scope)]
    if kind == "filter":
        f, of = FILTERS[e[1]], _expression(e[2])
        return lambda scope: f(of(scope))
    if kind == "not":
        of = _expression(e[1])
        return lambda scope: not of(scope)
    a, b = _expression(e[2]), _expression(e[3])
    if e[1] == "and":
        return lambda scope: a(scope) and b(scope)
    if e[1] == "or":
        return lambda scope: a(scope) or b(scope)
    op = _OPS[e[1]]
    return lambda scope: op(a(scope), b(scope))


def _statement(s) -> Callable[[dict, Output], None]:
    kind = s[0]
    if kind == "text":
        text = s[1]
        return lambda scope, out: out.write(text)
    if kind == "emit":
        value = _expression(s[1])
        return lambda scope, out: out.write(str(value(scope)))
    if kind == "set":
        name, value = s[1], _expression(s[2])
        return lambda scope, out: scope.__setitem__(name, value(scope))
    if kind == "for":
        name, values, inner = s[1], _expression(s[2]), _block(s[3])

        def loop(scope: dict, out: Output) -> None:
            for value in values(scope):
                inner(scope | {name: value}, out)

        return loop
    if kind == "if":
        arms = [(_expression(test), _block(inner)) for test, inner in s[1]]

        def choose(scope: dict, out: Output) -> None:
            for test, inner in arms:
                if test(scope):
                    return inner(scope, out)

        return choose
    inner = _block(s[1])

    def generation(scope: dict, out: Output) -> None:
        start = out.size
        inner(scope, out)
        out.spans.append((start, out.size))

    return generation


def _block(body: list) -> Callable[[dict, Output], None]:
    steps = [_statement(s) for s in body]

    def run(scope: dict, out: Output) -> None:
        for step in steps:
            step(scope, out)

    return run


def compile_template(source: str = DEFAULT) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """messages -> (formatted text, spans under the loss mask)."""
    run = _block(fold(parse(source)))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = Output()
        run({"messages": messages}, out)
        return "".join(out.parts), out.spans

    return render


#: A turn as the default template writes it. Marks inside texts are escaped, so the first free end is the turn's own.
#: Nothing is given back once matched, so a text's length costs no memory; the blank before the end is the text's last character.
_TURN = re.compile(r"### ((?:[^\\#<:]++|\\.)*+): ((?:[^\\#<]++|\\.)*+)(?<= )</turn>\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of text formatted by the default template."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError(f"no turn at {at}")
        out.append((unescape(m[1]), unescape(m[2][:-1])))
        at = m.end()
    return out


FORMATTED = T.StructType([T.StructField("conv_id", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss_spans", T.ArrayType(T.ArrayType(T.IntegerType())))])


def format_conversations(turns: DataFrame, template: str = DEFAULT) -> DataFrame:
    """conv_id, formatted text and loss spans ([start, end) in characters), one row a conversation."""
    parse(template)  # a wrong template fails here, not in the tasks
    one = F.struct(F.col("turn"), F.coalesce(F.col("role"), F.lit("user")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    whole = turns.groupBy(F.col("conv_id").cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("messages"))

    def make():
        render = compile_template(template)

        def rows(ids: list, conversations: list) -> Iterator[tuple]:
            for i, messages in zip(ids, conversations):
                text, spans = render(messages)
                yield i, text, [list(s) for s in spans]

        return rows

    return arrow_rows(whole, FORMATTED, make)


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of what the formatted conversations give back."""
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    added = r"\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", added), (-7, 1, "assistant", added)], turns.schema)
    schema = T.StructType([T.StructField(n, t()) for n, t in [("conv_id", T.LongType), ("n_turns", T.LongType), ("turns_sha256", T.StringType), ("loss_chars", T.LongType), ("loss_sha256", T.StringType), ("formatted_chars", T.LongType)]])

    def make():
        def rows(ids: list, texts: list, spans: list) -> Iterator[tuple]:
            for i, text, masked in zip(ids, texts, spans):
                turns, loss = read_back(text), "".join(unescape(text[a:b]) for a, b in masked)
                digest = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode()).hexdigest()
                yield i, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)

        return rows

    return arrow_rows(format_conversations(turns.unionByName(extra)), schema, make)
