"""Chat formatting by a small sandboxed template language.

    {{ path | filter }}            an expression: dotted names of the loop's variables, 'strings', filters, ==, !=, and, or, not
    {% for x in path %} {% endfor %}
    {% if a %} {% elif b %} {% else %} {% endif %}
    {% generation %} {% endgeneration %}   marks what the model is trained on

A template is parsed to a syntax tree, constants are folded (a comparison or filter of constants, text beside text,
branches whose condition is known), and Python closures are generated that render a conversation and record the
spans of its generation markers. Names reach only the data given; there are no calls, attributes or loops without end.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
TEMPLATE = "{% for m in messages %}" + START + "{{ m.role | escape_line }}\n{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}" + END + "\n{% endfor %}"


class TemplateError(ValueError):
    """The template is not in the language."""


def escape(text: str) -> str:
    """No control string is left in text; unescape undoes it."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_line(text: str) -> str:
    """Like escape, and on one line."""
    return escape(text).replace("\n", "\\n")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], text, flags=re.S)


FILTERS = {"escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower}


@dataclass
class Node:
    kind: str  # text, const, name, not, and, or, eq, ne, filter, out, for, if, generation, list
    value: object = None
    parts: list = field(default_factory=list)


_TAG = re.compile(r"\{%-?\s*(.*?)\s*-?%\}|\{\{\s*(.*?)\s*\}\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(==|!=|\||\(|\))|([A-Za-z_]\w*(?:\.\w+)*))")


def parse(template: str) -> Node:
    """The syntax tree of a template."""
    steps, at = [], 0
    for m in _TAG.finditer(template):
        if m.start() > at:
            steps.append(("text", template[at : m.start()]))
        steps.append(("tag", m[1]) if m[1] is not None else ("out", m[2]))
        at = m.end()
    if at < len(template):
        steps.append(("text", template[at:]))
    body, rest, stop = _block(steps, ())
    if stop or rest:
        raise TemplateError(f"unexpected {stop}")
    return body


def _block(steps: list, until: tuple[str, ...]) -> tuple[Node, list, str]:
    out = Node("list")
    while steps:
        (kind, value), steps = steps[0], steps[1:]
        if kind == "text":
            out.parts.append(Node("text", value))
        elif kind == "out":
            out.parts.append(Node("out", None, [_expression(value)]))
        else:
            word = value.split(None, 1)[0] if value else ""
            if word in until:
                return out, steps, value
            if word == "for":
                m = re.fullmatch(r"for\s+([A-Za-z_]\w*)\s+in\s+(.+)", value)
                if not m:
                    raise TemplateError(value)
                body, steps, stop = _block(steps, ("endfor",))
                _need(stop, value)
                out.parts.append(Node("for", m[1], [_expression(m[2]), body]))
            elif word == "if":
                node, steps = _branches(value[2:], steps)
                out.parts.append(node)
            elif word == "generation":
                body, steps, stop = _block(steps, ("endgeneration",))
                _need(stop, value)
                out.parts.append(Node("generation", None, [body]))
            else:
                raise TemplateError(f"unknown tag {value!r}")
    return out, steps, ""


def _need(stop: str, of: str) -> None:
    if not stop:
        raise TemplateError(f"{of!r} is not closed")


def _branches(condition: str, steps: list) -> tuple[Node, list]:
    body, steps, stop = _block(steps, ("elif", "else", "endif"))
    _need(stop, "if" + condition)
    other = Node("list")
    if stop.startswith("elif"):
        node, steps = _branches(stop[4:], steps)
        other.parts.append(node)
    elif stop == "else":
        other, steps, stop = _block(steps, ("endif",))
        _need(stop, "else")
    return Node("if", None, [_expression(condition), body, other]), steps


def _expression(source: str) -> Node:
    tokens, at = [], 0
    while at < len(source) and source[at:].strip():
        m = _TOKEN.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:]!r}")
        tokens.append(m)
        at = m.end()
    node, rest = _either(tokens)
    if rest:
        raise TemplateError(f"unexpected {rest[0][0].strip()!r}")
    return node


def _said(tokens, *words):
    return tokens and tokens[0][0].strip() in words


def _either(tokens):
    left, tokens = _both(tokens)
    while _said(tokens, "or"):
        right, tokens = _both(tokens[1:])
        left = Node("or", None, [left, right])
    return left, tokens


def _both(tokens):
    left, tokens = _denied(tokens)
    while _said(tokens, "and"):
        right, tokens = _denied(tokens[1:])
        left = Node("and", None, [left, right])
    return left, tokens


def _denied(tokens):
    if _said(tokens, "not"):
        node, tokens = _denied(tokens[1:])
        return Node("not", None, [node]), tokens
    left, tokens = _piped(tokens)
    if _said(tokens, "==", "!="):
        kind = "eq" if tokens[0][0].strip() == "==" else "ne"
        right, tokens = _piped(tokens[1:])
        return Node(kind, None, [left, right]), tokens
    return left, tokens


def _piped(tokens):
    if not tokens:
        raise TemplateError("an expression is missing")
    (first, *tokens) = tokens
    if first[0].strip() == "(":
        node, tokens = _either(tokens)
        if not _said(tokens, ")"):
            raise TemplateError("missing )")
        tokens = tokens[1:]
    elif first[1]:
        node = Node("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), first[1][1:-1], flags=re.S))
    elif first[3]:
        node = Node("const", first[3] == "true") if first[3] in ("true", "false") else Node("name", first[3].split("."))
    else:
        raise TemplateError(f"unexpected {first[0].strip()!r}")
    while _said(tokens, "|"):
        if len(tokens) < 2 or tokens[1][3] not in FILTERS:
            raise TemplateError("unknown filter")
        node, tokens = Node("filter", tokens[1][3], [node]), tokens[2:]
    return node, tokens


def fold(node: Node) -> Node:
    """The tree with constants computed, neighbouring texts joined and known branches taken."""
    parts = [fold(p) for p in node.parts]
    fixed = bool(parts) and all(p.kind == "const" for p in parts)
    if node.kind == "list":
        out: list[Node] = []
        for p in (q for p in parts for q in (p.parts if p.kind == "list" else [p])):
            if p.kind == "text" and out and out[-1].kind == "text":
                out[-1] = Node("text", out[-1].value + p.value)
            elif not (p.kind == "text" and not p.value):
                out.append(p)
        return Node("list", None, out)
    if node.kind in ("filter", "eq", "ne", "not", "and", "or") and fixed:
        return Node("const", _closure(Node(node.kind, node.value, parts))({}))
    if node.kind == "out" and fixed:
        return Node("text", _text(parts[0].value))
    if node.kind == "if" and parts[0].kind == "const":
        return parts[1] if parts[0].value else parts[2]
    return Node(node.kind, node.value, parts)


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


def _closure(node: Node):
    """A function of the variables that gives the expression's value."""
    kind, parts = node.kind, [_closure(p) for p in node.parts]
    if kind == "const":
        return lambda scope, v=node.value: v
    if kind == "name":
        head, *path = node.value

        def look(scope):
            value = scope.get(head)
            for name in path:
                value = value.get(name) if isinstance(value, dict) else None
            return value

        return look
    if kind == "filter":
        return lambda scope, f=FILTERS[node.value], a=parts[0]: f(_text(a(scope)))
    if kind == "not":
        return lambda scope, a=parts[0]: not a(scope)
    a, b = parts
    if kind == "eq":
        return lambda scope: a(scope) == b(scope)
    if kind == "ne":
        return lambda scope: a(scope) != b(scope)
    return (lambda scope: a(scope) and b(scope)) if kind == "and" else (lambda scope: a(scope) or b(scope))


class _Out:
    def __init__(self):
        self.parts: list[str] = []
        self.n = 0
        self.spans: list[tuple[int, int]] = []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.n += len(text)


def _writer(node: Node):
    """A function of the variables and an output that renders the node."""
    if node.kind == "list":
        parts = [_writer(p) for p in node.parts]
        if len(parts) == 1:
            return parts[0]

        def all_of(scope, out):
            for p in parts:
                p(scope, out)

        return all_of
    if node.kind == "text":
        return lambda scope, out, text=node.value: out.write(text)
    if node.kind == "out":
        value = _closure(node.parts[0])
        return lambda scope, out: out.write(_text(value(scope)))
    if node.kind == "if":
        test, yes, no = _closure(node.parts[0]), _writer(node.parts[1]), _writer(node.parts[2])
        return lambda scope, out: yes(scope, out) if test(scope) else no(scope, out)
    if node.kind == "generation":
        body = _writer(node.parts[0])

        def marked(scope, out):
            at = out.n
            body(scope, out)
            out.spans.append((at, out.n))

        return marked
    items, body, name = _closure(node.parts[0]), _writer(node.parts[1]), node.value

    def loop(scope, out):
        for item in items(scope) or ():
            body({**scope, name: item}, out)

    return loop


@cache
def compile_template(template: str):
    """render(messages) -> (text, spans of the generation markers in code points)."""
    write = _writer(fold(parse(template)))

    def render(messages: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out = _Out()
        write({"messages": messages}, out)
        return "".join(out.parts), out.spans

    return render


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of the turns of a text that TEMPLATE made."""
    turns = []
    for part in formatted.split(START)[1:]:
        head, _, rest = part.partition("\n")
        turns.append((unescape(head), unescape(rest[: rest.rindex(END)])))
    return turns


def format_chats(conversations: DataFrame, template: str = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, n_turns, formatted, spans (start, end of each generation marker).

    Turns are ordered by turn, then role, then text; equal turns and repeated rows all stay. A null role or text is
    empty; a null turn comes first; rows with a null id form one conversation. Other columns are ignored; an empty
    table gives an empty result. A conversation is one record, held by one task while it is rendered.
    """
    rows = conversations.select(conversations[id_col].alias("id"), conversations[turn_col].alias("turn"), F.coalesce(conversations[role_col], F.lit("")).alias("role"), F.coalesce(conversations[text_col], F.lit("")).alias("text"))
    kind = conversations.schema[id_col].dataType.simpleString()
    compile_template(template)  # errors show on the driver

    def run(batches):
        render = compile_template(template)
        empty, mark, turns = True, None, []

        def done():
            text, spans = render([{"role": r, "text": t} for r, t in turns])
            return mark, len(turns), text, [{"start": a, "end": b} for a, b in spans]

        def batch_of(found):
            a, n, text, spans = zip(*found)
            return pa.RecordBatch.from_arrays([pa.array(a, of), pa.array(n, pa.int64()), pa.array(text, pa.string()), pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], names=["id", "n_turns", "formatted", "spans"])

        found, of = [], None
        for batch in batches:
            of = batch.schema.field("id").type
            for key, role, text in zip(batch.column("id").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist()):
                if empty or key != mark:
                    if not empty:
                        found.append(done())
                        if len(found) >= 500:
                            yield batch_of(found)
                            found = []
                    empty, mark, turns = False, key, []
                turns.append((role, text))
        if not empty:
            found.append(done())
        if found:
            yield batch_of(found)

    dealt = rows.repartition("id").sortWithinPartitions("id", "turn", "role", "text").select("id", "role", "text")
    out = dealt.mapInArrow(run, f"id {kind}, n_turns long, formatted string, spans array<struct<start:long,end:long>>")
    return out.withColumnRenamed("id", id_col)


def digest(formatted: DataFrame, id_col: str = "conv_id") -> DataFrame:
    """What a reader gets back from formatted conversations, as digests."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column("formatted").to_pylist(), batch.column("spans").to_pylist()):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in spans)
                sha = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
                rows.append((len(turns), sha, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            n, turns, chars, loss, size = zip(*rows) if rows else ((),) * 5
            yield pa.RecordBatch.from_arrays([batch.column(id_col), pa.array(n, pa.int64()), pa.array(turns, pa.string()), pa.array(chars, pa.int64()), pa.array(loss, pa.string()), pa.array(size, pa.int64())], names=[id_col, "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    kind = formatted.schema[id_col].dataType.simpleString()
    return formatted.select(id_col, "formatted", "spans").mapInArrow(run, f"{id_col} {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
